import pytest

from siftwell.operators import html as H

NOISY = """<html><head><title>T</title></head><body><div class="mw-indicator"><div class="mw-parser-output">badge</div></div>
<div id="mw-content-text"><div class="mw-parser-output"><div id="toc">contents</div><p>Body stays.<sup class="reference">[1]</sup></p>
<span class="mw-editsection">[edit]</span><table class="navbox"><tr><td>nav</td></tr></table><div class="printfooter">printed from</div></div></div></body></html>"""


def wiki(inner):
    return f'<div id="mw-content-text"><div class="mw-parser-output">{inner}</div></div>'


PAGES = {
    "noisy": NOISY,
    "infobox": wiki('<div class="infobox"><table><tr><th>Health</th><td>20 <b>points</b></td></tr><tr><th>Size</th><td>1</td></tr><tr><th>Health</th><td>30</td></tr></table></div><p>Text.</p>'),
    "quiet infobox": wiki('<div class="noprint"><div class="infobox"><tr><th>a</th><td>b</td></tr></div></div><div class="notaninfobox"><table><tr><th>c<sup class="reference">1</sup></th><td>d</td></tr><tr><th></th><td>e</td></tr></table></div>'),
    "table": wiki('<table class="wikitable"><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>'),
    "tables": wiki('<div>x<table class="wikitable"><tr><td>1<table class="wikitable"><tr><td>2</td></tr></table></td></tr></table>y</div><table class="wikitable"></table><table class="wikitable noprint"><tr><td>3</td></tr></table><table><tr><td>4</td></tr></table>'),
    "headings": wiki('<p>i</p><h2>Obtaining</h2><p>a</p><h3>Mining</h3><p>b</p><div class="mw-heading"><h2>History<span class="mw-editsection">[edit]</span></h2></div><p>c</p><h3>1.0</h3><p>d</p><h2>Gallery</h2><ul><li>e<li>f</ul><h3>Upcoming</h3><p>g</p>'),
    "sprites": wiki('<p><span class="sprite-file"><img src="/images/x.png"></span><span class="sprite-text">Iron</span> ore</p>'),
    "images": wiki('<div class="infobox"><img src="/images/a.png?1" alt=" A "></div><h2>Use</h2><p>Before.</p><figure><img src="/images/b.png"><figcaption>Cap b</figcaption></figure><ul class="gallery"><li><img src="//cdn/images/c.png"> near</li></ul><img src="/images/a.png?2"><img src="/other/d.png">'),
    "frames": wiki('<figure><figcaption>outer</figcaption><figure><img src="/images/e.png"></figure></figure><div class="thumbinner"><p>said</p><img src="/images/f.png"><div class="thumbcaption">thumb</div>' + "w " * 200 + "</div>"),
    "links": wiki('<p><a href="/w/A">a</a><a href="/w/B#x">b</a><a href="/w/A">a</a></p><div class="navbox"><a href="/w/C">c</a></div><a href="/w/Category:D"> d  e</a><a>f</a>'),
    "null": None,
    "empty": "",
    "bare": "<span>x</span>",
    "article": "<article><h1>T</h1><p>one two",
    "odd": "<body></p></b><p>a\x1cb c<br/>&amp;<div/>d<!-- e --><ul><li>f",
    "many headings": "<body>" + "".join(f"<h{2 + i % 3}>{i}</h{2 + i % 3}><p>t{i}</p>" for i in range(400)),
    "deep": "<body>" + "<div>x" * 2000,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([*PAGES.items(), ("links", PAGES["links"])], "page_id string, html string")
    got = [r.asDict(True) for r in H.extract(rows, site="https://s").collect()]
    assert len(got) == len(PAGES) + 1  # a repeated page gives a row each
    return {r["page_id"]: r for r in got}


def sections(page):
    return [tuple(s.values()) for s in page["sections"]]


def test_noise_goes_and_the_main_root_is_chosen(found):
    assert found["noisy"]["title"] == "T" and [s["text"] for s in found["noisy"]["sections"]] == ["Body stays."]


def test_infobox_is_a_map_and_leaves_the_text(found):
    page = found["infobox"]
    assert page["infobox"] == [{"k": "Health", "v": "30"}, {"k": "Size", "v": "1"}] and sections(page) == [("Introduction", 1, "Text.", "content")] and page["word_count"] == 3


def test_infobox_in_noise_is_none(found):
    assert found["quiet infobox"]["infobox"] == [{"k": "c", "v": "d"}] and found["quiet infobox"]["sections"] == []


def test_table_in_markdown_is_padded_and_inlined(found):
    page = found["table"]
    assert page["tables"] == ["| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"] and page["sections"][0]["text"].startswith("| A | B |")


def test_tables_in_tables_and_in_noise(found):
    page = found["tables"]
    assert page["tables"] == ["| 1 2 | 2 |\n| 2 |", "| 2 |"] and sections(page) == [("Introduction", 1, "x | 1 2 | 2 | | 2 | y", "content")]


def test_breadcrumbs_and_types(found):
    assert sections(found["headings"]) == [
        ("Introduction", 1, "i", "content"), ("Obtaining", 2, "a", "content"), ("Obtaining > Mining", 3, "b", "content"), ("History", 2, "c", "history"),
        ("History > 1.0", 3, "d", "history"), ("Gallery", 2, "e f", "navigation"), ("Gallery > Upcoming", 3, "g", "future"),
    ]


def test_headings_beyond_a_block(found):
    def path(i):
        return " > ".join(str(j) for j in range(i - i % 3, i + 1))

    assert sections(found["many headings"]) == [(path(i), 2 + i % 3, f"t{i}", "content") for i in range(400)]


def test_breadcrumbs_of_headings(spark):
    rows = spark.createDataFrame([("p", 2, 3, "b"), ("p", 1, 2, "History"), ("q", 1, 3, "c"), ("p", 3, 2, "d")], "page string, ordinal int, level int, heading string")
    got = sorted(tuple(r) for r in H.breadcrumbs(rows, "page").collect())
    assert got == [("p", 1, 2, "History", "History", "history"), ("p", 2, 3, "b", "History > b", "history"), ("p", 3, 2, "d", "d", "content"), ("q", 1, 3, "c", "c", "content")]


def test_sprites_keep_their_text(found):
    assert found["sprites"]["sections"][0]["text"] == "Iron ore"


def test_images_have_context_caption_section_and_surroundings(found):
    images = {i["url"]: i for i in found["images"]["images"]}
    assert list(images) == ["https://s/images/a.png", "https://s/images/b.png", "https://s//cdn/images/c.png"]
    assert images["https://s/images/a.png"]["context_type"] == "infobox" and images["https://s/images/a.png"]["section"] == "Introduction" and images["https://s/images/a.png"]["alt_text"] == "A"
    assert images["https://s/images/b.png"]["caption"] == "Cap b" and images["https://s/images/b.png"]["context_type"] == "figure" and images["https://s/images/b.png"]["section"] == "Use"
    assert images["https://s//cdn/images/c.png"]["context_type"] == "gallery" and images["https://s//cdn/images/c.png"]["surrounding_text"] == "near"


def test_captions_of_outer_frames_and_long_surroundings(found):
    e, f = found["frames"]["images"]
    assert (e["caption"], e["context_type"]) == ("outer", "figure") and (f["caption"], f["context_type"]) == ("thumb", "thumbnail")
    assert f["surrounding_text"] == ("said saidthumb" + "w " * 200)[:200] + "..."


def test_links_leave_navigation_out(found):
    assert found["links"]["hrefs"] == ["/w/A", "/w/B#x", "/w/Category:D"] and found["links"]["categories"] == ["d e"]


def test_bad_pages_have_an_error(found):
    assert found["null"]["error"] == found["empty"]["error"] == "empty page" and found["bare"]["error"] == "no content element"
    assert all(found["bare"][n] == [] for n in H.TYPES) and found["null"]["word_count"] == 0
    assert found["article"]["error"] is None and found["article"]["word_count"] == 2


def test_odd_and_deep_markup(found):
    assert sections(found["odd"]) == [("Introduction", 1, "a b c & d f", "content")]
    assert found["deep"]["word_count"] == 2000


def test_no_pages(spark):
    assert H.extract(spark.createDataFrame([], "page_id bigint, html string")).collect() == []

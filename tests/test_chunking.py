import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from siftwell.operators import chunking as C

WORDS = st.lists(st.sampled_from(["alpha", "beta", "gamma.", "delta!", "eps?", "- item", "\n", "\n- a", "\n1. b", "\n\n"]), max_size=80).map(" ".join)


@given(WORDS)
@settings(max_examples=200, deadline=None)
def test_pieces_hold_the_budget_and_every_word(text):
    pieces = C.split_text(text, 8, 3)
    assert all(C.count(p) <= 8 for p in pieces)
    assert set(text.split()) <= set(" ".join(pieces).split())


def test_carried_sentences_leave_room_for_the_next():
    assert C.split_text("alpha alpha gamma. alpha alpha alpha alpha alpha alpha", 8, 3) == ["alpha alpha gamma.", "alpha alpha alpha alpha alpha alpha"]
    assert C.split_text("a. b c. d e f g. h i j k l.", 6, 4) == ["a. b c.", "b c. d e f g.", "h i j k l."]
    assert C.split_text("a b. c. d e f g h.", 6, 3) == ["a b. c.", "c. d e f g h."]


@given(WORDS, st.integers(5, 40))
@settings(max_examples=200, deadline=None)
def test_recursive_pieces_fit(text, size):
    assert all(len(p) <= size for p in C.split_recursive(text, size, 2))


def test_overlap_is_whole_sentences():
    text = "One two three. Four five. Six seven eight. Nine ten."
    assert C.split_text(text, 6, 3) == ["One two three. Four five.", "Four five. Six seven eight.", "Six seven eight. Nine ten."]


def test_lists_do_not_overlap_and_giant_units_are_split():
    assert C.split_text("Lead in.\n- a b c\n- d e f", 5, 5) == ["Lead in. - a b c", "- d e f"]
    assert C.split_text("a b c d e f g.", 3, 2) == ["a b c", "d e f", "g."]
    assert C.list_blocks("p\n\nq\n- a\n\n- b\nr") == [("p\nq", False), ("- a", True), ("- b", True), ("r", False)]


def test_table_pieces_repeat_the_header():
    assert C.split_table("|A|\n|---|\n|1|\n|2|\n|3|", 3) == ["|A|\n|---|\n|1|\n|2|", "|A|\n|---|\n|3|"]
    assert C.split_table("|A|\n|---|\n|1|\n|2|", 1) == ["|A|\n|---|\n|1|", "|A|\n|---|\n|2|"]
    assert C.split_table("|A|", 1) == ["|A|"]


def test_small_neighbours_merge(spark):
    rows = [("p", 0, "A", "a b", 2, "section"), ("p", 1, "B", "c", 1, "section"), ("p", 2, "C", "x " * 60, 60, "section"), ("p", 3, "D", "d", 1, "section"), ("p", 4, "E", "e", 1, "table"), ("p", 5, "E", "f", 1, "table"), ("q", 0, "Z", "z", 1, "section")]
    got = C.merge_small(spark.createDataFrame(rows, "page string, ordinal bigint, heading string, text string, token_count bigint, chunk_type string"), "page")
    assert [tuple(r) for r in got.where("page = 'p'").orderBy("place").select("place", "heading", "text", "token_count").collect()] == [
        (0, "A + B", "a b\n\nc", 3), (1, "C", "x " * 60, 60), (2, "D", "d", 1), (3, "E", "e\nf", 2)
    ]
    assert got.where("page = 'q'").count() == 1


def test_merged_chunks_have_ids_images_and_types(spark):
    picture = lambda x: [(x, "infobox")] if x else []
    rows = [("p", 0, "A", "a b", 2, "section", "history", 2, picture("1"), "i0"), ("p", 1, "B > A", "c", 1, "section", "future", 3, picture("2"), "i1"), ("p", 2, "A", "d", 1, "section", "content", 4, [], "i2"),
            ("p", 3, "C", "x " * 60, 60, "section", "history", 2, picture("3"), "i3"), ("p", 4, "D", "e", 1, "section", "history", 2, picture("4"), "i4"), ("q", 0, "Z", "z", 1, "section", "history", 2, picture("5"), "i5")]
    df = spark.createDataFrame(rows, "page string, ordinal bigint, heading string, text string, token_count bigint, chunk_type string, section_type string, level int, images array<struct<url string, context_type string>>, chunk_id string")
    got = {(r.page, r.place): r for r in C.merge_small(df, "page").collect()}

    def of(r):
        return r.heading, r.text, r.token_count, r.section_type, r.level, [i.url for i in r.images], r.chunk_id

    def own(*parts):
        return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:16]

    assert of(got["p", 0]) == ("A + B > A", "a b\n\nc\n\nd", 4, "content", 2, ["1", "2"], own("p", "A + B > A", 0))
    assert of(got["p", 1]) == ("C", "x " * 60, 60, "history", 2, ["3"], "i3")
    assert of(got["p", 2]) == ("D", "e", 1, "content", 2, ["4"], own("p", "D", 2))
    assert of(got["q", 0]) == ("Z", "z", 1, "history", 2, ["5"], "i5") and len(got) == 4


def test_section_chunks_and_corpus(spark):
    long = " ".join(f"word{k}." for k in range(1200))
    rows = [("P", 0, "Intro", 1, "tiny", "content"), ("P", 1, "Past", 2, "one two three four five six seven eight nine ten", "history"), ("P", 2, "Long", 2, long, "content")]
    sections = spark.createDataFrame(rows, "title string, ordinal int, heading string, level int, text string, section_type string")
    chunks = C.section_chunks(sections, "title").collect()
    assert all(r.token_count <= 512 for r in chunks) and {r.heading for r in chunks} == {"Past", "Long"} and sum(r.heading == "Long" for r in chunks) == 3
    assert [r.chunk_id for r in chunks if r.heading == "Past"] == [hashlib.md5(b"P|Past (history)|0").hexdigest()[:16]]
    types = spark.createDataFrame([("Q", "mob")], "title string, page_type string")
    related = spark.createDataFrame([("P", ["X"])], "title string, related_pages array<string>")
    out = C.corpus_chunks(sections, "title", types, related).first()
    assert out.page_type == "other" and out.related_pages == ["X"]

import base64
import hashlib
import random
import re
from html.parser import HTMLParser

import duckdb
import pytest
from siftwell.llm import url_filter, warc
from siftwell.llm.queries import ORACLES, QUERIES

HOSTS = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "notexample.com", "org", ""]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


@pytest.mark.parametrize("sweep", [0, 1000])
def test_rules_against_brute_force(spark, sweep):
    rnd = random.Random(5)
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h in HOSTS for p in ("/", "/en/", "/en/a", "", "/x") if rnd.random() < 0.6}.values())
    urls = [None, "", "no scheme", "http://", "https://COM", "http://www.EXAMPLE.com?x=/en/", "http://example.com#/en/", "ftp://com/En/", "http://.com/", "http://com./"]
    urls += [f"http://{rnd.choice(HOSTS)}{rnd.choice(['', ':80', '.'])}{rnd.choice(['', '/', '/en', '/en/', '/en/abc', '/xy', '/fr/'])}{rnd.choice(['', '?q=1', '#f', '?a://b/'])}" for _ in range(400)]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(None, "http://example.com/en/", "x")] * 2, "page_id bigint, url string, host string")
    got = url_filter.judged(pages, url_filter.rule_table(spark, rules), sweep_rules=sweep).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else "http://example.com/en/"
        assert (r.host, r.path, r.rule, r.verdict) == brute(url, rules), url
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark, rules), sweep_rules=sweep).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, url_filter.rule_table(spark, rules).limit(0), sweep_rules=sweep).collect()} == {"allow"}


def test_url_oracle(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql("SELECT page_id, host, path, rule, verdict FROM (" + ORACLES["op8_url_filter"] + ")").fetchall()
    assert sorted(map(tuple, QUERIES["op8_url_filter"](spark, sf).collect())) == sorted(want)


def sha1(raw):
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_warc_whole_table_links_and_digests(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = {r.page_id: bytes(r.record) for r in warc.responses(pages).collect()}
    got = {}
    for r in warc.derivatives(warc.responses(pages)).collect():
        got.setdefault(r.page_id, {})[r.kind] = r
    assert len(got) == len(made) and all(set(v) == {"metadata", "conversion"} for v in got.values())
    assert QUERIES["op10_warc_derivatives"](spark, sf).count() == 2 * len(made)
    for k, kinds in got.items():
        source, _ = warc.parsed(made[k])
        source = dict(source)
        for r in kinds.values():
            headers, block = warc.parsed(bytes(r.record))
            h = dict(headers)
            assert h["WARC-Type"] == r.kind and h["WARC-Refers-To"] == source["WARC-Record-ID"] == r.refers_to and h["WARC-Target-URI"] == source["WARC-Target-URI"] == r.target_uri
            assert h["WARC-Block-Digest"] == sha1(block) == r.block_digest and len(block) == r.n_bytes and h["WARC-Record-ID"] == r.record_id
        text = warc.parsed(bytes(kinds["conversion"].record))[1].decode()
        assert "<p>" not in text and "track(" not in text and "&amp;" not in text
        assert f"source-payload-digest: {source['WARC-Payload-Digest']}" in warc.parsed(bytes(kinds["metadata"].record))[1].decode()


def test_plain_text():
    page = "<html><head><title>T &amp; x</title><style>p{}</style></head><body><!-- c --><p>One<b>two</b> &lt;3<p>Four<br>five<script>var a='</p>';</script> six</body>"
    assert warc.plain_text(page) == "T & x\nOnetwo <3\nFour\nfive six"
    assert warc.plain_text("") == "" and warc.plain_text("<script>open") == "" and warc.plain_text("a < b") == "a < b"


class Reader(HTMLParser):
    """A second reader, over the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.begun, self.hidden = [], [], None, None, []

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.hidden += [tag] * (tag == self.hidden[0])
        elif tag in ("script", "style", "noscript", "template"):
            self.hidden = [tag]
        else:
            self.parts.append("\n" if tag in warc._BLOCKS else "")
            if tag == "a":
                self.links += [v or "" for k, v in attrs if k == "href"][:1]
            if tag == "title" and self.title is None:
                self.begun = len(self.parts)

    def handle_startendtag(self, tag, attrs):
        if tag not in ("script", "style", "noscript", "template"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = self.hidden[1:] if tag == self.hidden[0] else self.hidden
            return
        self.parts.append("\n" if tag in warc._BLOCKS else "")
        if tag == "title" and self.title is None and self.begun is not None:
            self.title = " ".join("".join(self.parts[self.begun :]).split())

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def second_reading(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    lines = (re.sub(r"[^\S\n]+", " ", x).strip() for x in "".join(reader.parts).split("\n"))
    return "\n".join(x for x in lines if x), reader.title, list(dict.fromkeys(reader.links))


def test_pages_read_alike_by_a_second_reader(sf):
    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    rnd = random.Random(6)
    pieces = ["<p>", "</p>", '<a title="a > b" href="/x">t</a>', "<a title='see href=\"foo\"' href=\"bar\">u</a>", "<A HREF=/y?a=1&amp;b=2>v", "<a data-href=no href='a b'>", "<title> T <b>x</b> </title>", "<script>if (a<b) x('</p>')</script>", "<style>a>b</style>", "<noscript><p>no</noscript>", "<template>t<template>u</template>v</template>", "<!-- <a href=z> -->", "&lt;p&gt;", "text  text", "\n", "<br/>", "<script/>", "<img alt='>'>", "é &eacute;", "a < b", "</div>"]
    odd = ["".join(rnd.choices(pieces, k=rnd.randint(1, 14))) + "</a>" for _ in range(200)]
    for page in (*pages, *odd):
        assert warc.read_page(page) == second_reading(page), page


def test_encoded_and_broken_records(spark):
    import gzip

    body = gzip.compress(b"<p>h\xe9</p>")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n" % len(body) + body + b"\r\n0\r\n\r\n"
    good = warc.record("response", [("WARC-Record-ID", "<urn:x:1>"), ("WARC-Date", "2020-01-01T00:00:00Z")], http)
    image = warc.record("response", [("WARC-Record-ID", "<urn:x:2>")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\nPNG")
    rows = [(1, good), (2, image), (3, good[:-20]), (4, warc.record("warcinfo", [], b"")), (5, b"junk"), (6, None), (None, good), (None, good), (7, warc.record("response", [("WARC-Record-ID", "<urn:x:3>")], b"no http"))]
    df = spark.createDataFrame([(k, None if r is None else bytearray(r)) for k, r in rows], "page_id bigint, record binary").withColumnRenamed("page_id", "kind")
    got = warc.derivatives(df, key="kind").toDF("page_id", "kind", *["c%d" % i for i in range(8)]).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.page_id, []).append(r.kind)
    assert sorted(kinds[1]) == ["conversion", "metadata"] and kinds[2] == ["metadata"] and all(kinds[k] == ["invalid"] for k in (3, 4, 5, 6, 7)) and len(kinds[None]) == 4
    assert warc.parsed(warc.derived(good)[1]["record"])[1].decode() == "hé"


def test_warc_null_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a/ b", ""), (None, "http://a/", "<p>x</p>")], "page_id bigint, url string, html string")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 6 and not any(r.error for r in got) and {r.target_uri for r in got if r.page_id == 2} == {"http://a/%20b"}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0

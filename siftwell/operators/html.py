"""Structured extraction from HTML pages.

Each page is cut into tags and texts in linear time and turned into a flat list of
nodes in document order; all that is taken from a page is a Column expression over that
list, so a page stays one row and nothing is shuffled. A node's elements and
texts are the list's run from its own place to its last, and for a few named
selectors each node carries the place of the nearest element, itself or above,
that fits.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import Cutter
from ..functions.urls import SITE
from ..shipping import ship

#: Elements without an end tag, and those that an opening tag ends (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": {"p", "ul", "ol", "dl", "div", "table", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure", "section", "article"},
    "li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
}
#: What a page's text leaves out: tag.class, tag#id or .class (fixed values).
NOISE = (
    "div#toc", "span.mw-editsection", "pre.history-json", "pre.chest-json", "div.printfooter", "div#catlinks", "table.navbox", ".navigation-not-searchable", "noscript",
    "sup.reference", "div.reflist", "ol.references", "ul.gallery", "style", "script", ".noprint", "div.magnify", ".mw-editsection-bracket",
)
HEADINGS = ("h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "ul", "ol", "dl", "blockquote", "div")
#: Words in headings that set a section's type (fixed values).
HISTORY_TOP, FUTURE_TOP = ("history", "legacy", "past version"), ("future", "upcoming", "snapshot", "preview", "experimental")
HISTORY_DEEP, FUTURE_DEEP = ("history", "past", "legacy"), ("future", "upcoming")
NAVIGATION = ("gallery", "references", "see also", "external links")

#: Named selectors of which nodes carry the nearest element; tag*text: text stands in the class attribute.
NEAREST = {
    "noise": (*NOISE, ".sprite-file"),
    "menu": tuple(f"{tag}*{text}" for tag in ("div", "table") for text in ("navbox", "navigation-not-searchable", "noprint")),
    "context": (".infobox", ".gallery", ".thumb", ".thumbinner", "figure", ".navbox"),
    "block": ("p", "div", "li", "td"),
    "wikitable": ("table.wikitable",),
}
NODE = pa.struct([*((n, pa.int32()) for n in ("at", "until", "parent")), *((n, pa.string()) for n in ("tag", "id")), ("classes", pa.list_(pa.string())), *((n, pa.string()) for n in ("text", "link", "alt")), *((n, pa.int32()) for n in NEAREST)])
SCHEMA = "array<struct<at:int,until:int,parent:int,tag:string,id:string,classes:array<string>,text:string,link:string,alt:string," + ",".join(f"{n}:int" for n in NEAREST) + ">>"
#: Nodes of so many go into one Arrow batch; a longer page is a batch by itself.
NODES_A_BATCH = 50_000

#: Headings of so many are folded together.
BLOCK = 128
OUTLINE = "array<struct<path:string,level:int,section_type:string>>"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
SURROUNDING = 200
TYPES = {
    "sections": "array<struct<heading:string,level:int,text:string,section_type:string>>", "infobox": "array<struct<k:string,v:string>>", "tables": "array<string>",
    "images": "array<struct<url:string,alt_text:string,section:string,context_type:string,caption:string,surrounding_text:string>>", "hrefs": "array<string>", "categories": "array<string>",
}


@lru_cache(maxsize=256)
def _parts(selector: str) -> tuple[str, str, str]:
    """Tag, mark and name of tag, tag.class, tag#id, .class or tag*text."""
    return re.fullmatch(r"(\w*)([.#*]?)(.*)", selector).groups()


@lru_cache(maxsize=4096)
def _fitting(tag: str, ident: str, classes: str) -> tuple[bool, ...]:
    """Which selectors of NEAREST an element fits."""
    found = {"": (), ".": classes.split(), "#": (ident,), "*": classes}
    parts = ([_parts(s) for s in selectors] for selectors in NEAREST.values())
    return tuple(any((not t or t == tag) and (not mark or name in found[mark]) for t, mark, name in p) for p in parts)


class _Nodes:
    """Elements and texts of one page in document order: (parent, tag, id, classes, text, link, alt, *nearest), and the last place inside each."""

    def __init__(self):
        self.rows, self.until = [], []
        self.open = [(-1, "", (-1,) * len(NEAREST))]
        self.named = Counter()  # how many of each tag are open

    def _add(self, tag: str, ident: str, classes: str, *rest: str) -> tuple:
        at = len(self.rows)
        parent, _, nearest = self.open[-1]
        if tag:
            nearest = tuple(at if own else above for own, above in zip(_fitting(tag, ident, classes), nearest))
        self.rows.append((parent, tag, ident, classes.split(), *rest, *nearest))
        self.until.append(at)
        return at, tag, nearest

    def _end(self) -> None:
        at, tag, _ = self.open.pop()
        self.named[tag] -= 1
        self.until[at] = len(self.rows) - 1

    def _start(self, tag: str, have: dict[str, str], empty: bool) -> None:
        while self.open[-1][1] in CLOSES and tag in CLOSES[self.open[-1][1]]:
            self._end()
        node = self._add(tag, have.get("id", ""), have.get("class", ""), "", have.get("href" if tag == "a" else "src", ""), have.get("alt", ""))
        if tag not in VOID:
            self.open.append(node)
            self.named[tag] += 1
            if empty:
                self._end()

    def parsed(self, page: str, resolve: Callable[[str], str] = html.unescape) -> list[tuple]:
        for kind, first, *rest in Cutter(page, resolve).tokens():
            if kind == "text":
                self._add("", "", "", first, "", "")
            elif kind == "start":
                self._start(first, *rest)
            elif self.named[first]:
                while self.open[-1][1] != first:
                    self._end()
                self._end()
        while len(self.open) > 1:
            self._end()
        return [(at, last, *row) for at, (last, row) in enumerate(zip(self.until, self.rows))]


def _nodes_of(page: str | None, resolve: Callable[[str], str]) -> tuple[list[tuple], str | None]:
    return (_Nodes().parsed(page, resolve), None) if page else ([], "empty page")


def elements(pages: DataFrame, key: str = "page_id", page: str = "html", resolve: Callable[[str], str] = html.unescape) -> DataFrame:
    """(key, nodes, error): each page's nodes in document order, entities of texts resolved by resolve; a page that cannot be read has an error and none."""
    ship(pages.sparkSession)
    source = pages.select(F.col(key).alias("key"), F.col(page).cast("string").alias("page"))

    def batch_of(keys: pa.Array, found: list) -> pa.RecordBatch:
        flat = list(zip(*(n for nodes, _ in found for n in nodes))) or [()] * len(NODE)
        offsets = [0]
        for nodes, _ in found:
            offsets.append(offsets[-1] + len(nodes))
        columns = [pa.array(c, f.type) for c, f in zip(flat, NODE)]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(NODE)))
        return pa.RecordBatch.from_arrays([keys, lists, pa.array([e for _, e in found], pa.string())], names=["key", "nodes", "error"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first, size = [], 0, 0
            for text in batch.column(1):
                found.append(_nodes_of(text.as_py(), resolve))
                size += len(found[-1][0])
                if size >= NODES_A_BATCH:
                    yield batch_of(batch.column(0).slice(first, len(found)), found)
                    first, found, size = first + len(found), [], 0
            if found:
                yield batch_of(batch.column(0).slice(first, len(found)), found)

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(parse, f"key {kind}, nodes {SCHEMA}, error string").withColumnRenamed("key", key)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once although lambdas inside use refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}\z", "")


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, BLANKS), lambda w: w != ""))


def _fits(n: Column, selector: str) -> Column:
    tag, mark, name = _parts(selector)
    own = F.lit(True) if not tag else n["tag"] == tag
    return own if not mark else own & (F.array_contains(n["classes"], name) if mark == "." else n["id"] == name)


def _first(nodes: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(nodes, test), F.lit(0))


class _Page:
    """Column expressions over the nodes of a page, its content element (root) and its infobox (box)."""

    def __init__(self, nodes: Column, root: Column, box: Column | None = None):
        self.nodes, self.root, self.box = nodes, root, box

    def inside(self, n: Column, itself: bool = False) -> Column:
        """Nodes below n, after n itself if asked."""
        return F.slice(self.nodes, n["at"] + (1 if itself else 2), n["until"] - n["at"] + (1 if itself else 0))

    def all(self, n: Column, test: Callable[[Column], Column]) -> Column:
        return F.filter(self.inside(n), test)

    def text(self, n: Column) -> Column:
        """All text below n, noise too."""
        return _let(n, lambda v: _clean(F.array_join(self.all(v, lambda x: x["tag"] == "")["text"], "")))

    def quiet(self, n: Column) -> Column:
        """Whether n does not stand in noise of the content."""
        return n["noise"] <= self.root["at"]

    def kept(self, n: Column) -> Column:
        """Whether n stands neither in noise nor in the infobox."""
        return self.quiet(n) & ~F.coalesce(n["at"].between(self.box["at"], self.box["until"]), F.lit(False))

    def heading(self, n: Column, test: Callable[[Column], Column]) -> Column:
        """The heading that a node is, or wraps."""
        return F.when(n["tag"].isin(*HEADINGS), n).when(_fits(n, "div.mw-heading"), _first(self.inside(n), lambda x: x["tag"].isin(*HEADINGS) & test(x)))

    def infobox(self) -> Column:
        """Keys and values of the infobox; a later key replaces a former value."""

        def said(n: Column) -> Column:
            return _let(n, lambda v: _clean(F.array_join(self.all(v, lambda x: (x["tag"] == "") & self.quiet(x))["text"], " ")))

        def cell(row: Column, tag: str) -> Column:
            return _first(self.inside(row), lambda x: (x["tag"] == tag) & self.quiet(x))

        def pair(row: Column) -> Column:
            return F.struct(said(cell(row, "th")).alias("k"), said(cell(row, "td")).alias("v"))

        rows = F.transform(self.all(self.box, lambda x: (x["tag"] == "tr") & self.quiet(x)), pair)
        pairs = F.reverse(F.filter(rows, lambda p: (p["k"] != "") & (p["v"] != "")))
        last = lambda p, k: F.get(p["v"], (F.array_position(p["k"], k) - 1).cast("int"))
        return _let(pairs, lambda p: F.transform(F.array_distinct(F.reverse(p["k"])), lambda k: F.struct(k.alias("k"), last(p, k).alias("v"))))

    def markdown(self, t: Column) -> Column:
        """A table in Markdown: all header cells first, rows filled up to their number, never cut."""

        def cells(row: Column, tag: str) -> Column:
            return F.transform(self.all(row, lambda x: (x["tag"] == tag) & self.kept(x)), lambda c: self.spaced(self.all(c, lambda x: (x["tag"] == "") & self.kept(x))["text"]))

        def line(row: Column) -> Column:
            return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

        def lines(rows: Column, head: Column) -> Column:
            top = F.when(F.size(head) > 0, F.array(line(head), line(F.transform(head, lambda _: F.lit("---"))))).otherwise(F.array().cast("array<string>"))
            body = F.filter(F.transform(rows, lambda r: cells(r, "td")), lambda r: F.size(r) > 0)
            return F.array_join(F.concat(top, F.transform(body, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), F.size(head) - F.size(r)))))), "\n")

        rows = self.all(t, lambda x: (x["tag"] == "tr") & self.kept(x))
        return _let(rows, lambda r: _let(F.flatten(F.transform(r, lambda x: cells(x, "th"))), lambda head: lines(r, head)))

    def spaced(self, texts: Column) -> Column:
        return F.array_join(F.filter(F.transform(texts, _strip), lambda s: s != ""), " ")

    def table(self, n: Column) -> Column:
        return (n["wikitable"] == n["at"]) & self.kept(n)

    def tables(self) -> Column:
        return F.filter(F.transform(self.all(self.root, self.table), self.markdown), lambda t: t != "")

    def strings(self, n: Column) -> Column:
        """What n says: texts outside tables, and outermost tables in Markdown."""
        outer = lambda x: self.table(x) & (F.get(self.nodes, x["parent"])["wikitable"] <= self.root["at"])
        said = F.filter(self.inside(n, itself=True), lambda x: F.when(x["tag"] == "", (x["wikitable"] <= self.root["at"]) & self.kept(x)).otherwise(outer(x)))
        return F.transform(said, lambda x: F.when(x["tag"] == "", x["text"]).otherwise(self.markdown(x)))

    def sections(self, empty: bool = False) -> Column:
        """The direct children of the content in order, cut at headings; texts, tables and blocks are what a section says; those that say nothing go, unless empty keeps the ones with a heading."""

        def child(n: Column) -> Column:
            says = (n["tag"] == "") | self.table(n) | (n["tag"].isin(*BLOCKS) & ~_fits(n, "div.mw-heading"))
            return _let(self.heading(n, self.kept), lambda h: _let(F.coalesce(h, F.when(says, n)), lambda v: _let(self.strings(v), lambda strings: said(h, strings))))

        def said(h: Column, strings: Column) -> Column:
            heading = F.when(h.isNotNull(), _clean(F.array_join(strings, "")))
            return F.struct(F.substring(h["tag"], 2, 1).cast("int").alias("level"), heading.alias("heading"), F.when(h.isNull(), self.spaced(strings)).alias("said"))

        def cut(children: Column) -> Column:
            places = F.filter(F.transform(children, lambda c, i: F.struct(i.alias("i"), c["level"].alias("level"), c["heading"].alias("heading"))), lambda h: h["level"].isNotNull())
            introduction = F.struct(F.lit("Introduction").alias("path"), F.lit(1).alias("level"), F.lit("content").alias("section_type"))
            return _let(places, lambda h: _let(F.concat(F.array(introduction), outline(h)), lambda o: _let(h["i"], lambda at: filled(children, at, o))))

        def filled(children: Column, places: Column, outlined: Column) -> Column:
            def section(o: Column, i: Column) -> Column:
                start = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
                stop = F.coalesce(F.get(places, i), F.size(children))
                text = _clean(F.array_join(F.slice(children, start + 1, stop - start)["said"], " "))
                return F.struct(o["path"].alias("heading"), o["level"].alias("level"), text.alias("text"), o["section_type"].alias("section_type"))

            return F.filter(F.transform(outlined, section), lambda s, i: (s["text"] != "") | (F.lit(empty) & (i > 0)))

        return _let(F.transform(F.filter(self.inside(self.root), lambda n: (n["parent"] == self.root["at"]) & self.kept(n)), child), cut)

    def hrefs(self) -> Column:
        """Distinct links outside navigation, in order."""
        return F.array_distinct(self.all(self.root, lambda n: (n["tag"] == "a") & (n["link"] != "") & (n["menu"] < self.root["at"]))["link"])

    def categories(self) -> Column:
        return F.transform(F.filter(self.nodes, lambda n: (n["tag"] == "a") & n["link"].contains("/w/Category:")), self.text)

    def images(self, site: str) -> Column:
        """Images of the wiki's folder, one a URL, with where and how they are used; noise counts here."""
        above = lambda f, n: (f["at"] < n["at"]) & (f["until"] >= n["at"])

        def source(n: Column) -> Column:
            url = F.substring_index(n["link"], "?", 1)
            up = F.get(self.nodes, n["parent"])
            near = [F.when(up[c] >= self.root["at"], up[c]).alias(c) for c in ("context", "block")]
            return F.struct(F.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url).alias("url"), _clean(n["alt"]).alias("alt"), n["at"].alias("at"), n["parent"].alias("parent"), *near)

        def framed(f: Column) -> Column:
            own = F.when(f["tag"] == "figure", _first(self.inside(f), lambda x: x["tag"] == "figcaption")).otherwise(_first(self.inside(f), lambda x: _fits(x, "div.thumbcaption")))
            return F.struct(f["at"].alias("at"), f["until"].alias("until"), self.text(own).alias("said"))

        def headed(n: Column) -> Column:
            name = self.text(self.heading(n, lambda x: F.lit(True)))
            return F.struct(n["parent"].alias("parent"), n["at"].alias("at"), n["until"].alias("until"), name.alias("name"))

        def image(n: Column, frames: Column, heads: Column, blocks: Column, texts: Column, earlier: Column) -> Column:
            at = F.get(self.nodes, n["context"])
            kinds = (("infobox", _fits(at, ".infobox")), ("gallery", _fits(at, ".gallery")), ("thumbnail", _fits(at, ".thumb") | _fits(at, ".thumbinner")), ("figure", at["tag"] == "figure"), ("navbox", _fits(at, ".navbox")))
            kind = F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in kinds], F.lit("inline"))
            caption = F.array_max(F.filter(frames, lambda f: above(f, n)))["said"]
            section = F.array_max(F.filter(heads, lambda h: (h["until"] < n["at"]) & (F.get(self.nodes, h["parent"])["until"] >= n["at"])))["name"]
            before = self.text(F.array_max(F.filter(earlier, lambda e: (e["parent"] == n["parent"]) & (e["at"] < n["at"]))))
            around = F.get(texts, (F.array_position(blocks, n["block"]) - 1).cast("int"))
            said = F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(around, F.lit("")))
            said = F.when(F.length(said) > SURROUNDING, F.concat(F.substring(said, 1, SURROUNDING), F.lit("..."))).otherwise(said)
            return F.struct(
                n["url"].alias("url"), n["alt"].alias("alt_text"), F.coalesce(section, F.lit("Introduction")).alias("section"), kind.alias("context_type"),
                F.coalesce(caption, F.lit("")).alias("caption"), said.alias("surrounding_text"),
            )

        def all_images(found: Column) -> Column:
            frames = F.filter(F.transform(F.filter(self.inside(self.root, itself=True), lambda x: (x["tag"] == "figure") | _fits(x, ".thumbinner")), framed), lambda f: f["said"].isNotNull())
            heads = F.filter(F.transform(F.filter(self.inside(self.root), lambda x: x["tag"].isin(*HEADINGS) | _fits(x, "div.mw-heading")), headed), lambda h: h["name"].isNotNull())
            earlier = F.transform(self.all(self.root, lambda x: x["tag"].isin("p", "div", "li")), lambda x: F.struct(x["at"].alias("at"), x["until"].alias("until"), x["parent"].alias("parent")))
            blocks = F.array_distinct(F.filter(found["block"], lambda b: b.isNotNull()))
            return _let(blocks, lambda b: _let(F.transform(b, lambda at: self.text(F.get(self.nodes, at))), lambda t: _let(frames, lambda f: _let(heads, lambda h: _let(earlier, lambda e: F.transform(found, lambda n: image(n, f, h, b, t, e)))))))

        sources = F.transform(self.all(self.root, lambda n: (n["tag"] == "img") & n["link"].contains("/images/")), source)
        return _let(_let(sources, lambda s: F.filter(s, lambda n, i: F.array_position(s["url"], n["url"]) == i + 1)), all_images)


def section_mark(level: Column, heading: Column) -> Column:
    """The section type that a heading sets: one of the second level always, deeper ones history, future or null."""
    low = F.lower(heading)
    has = lambda words: low.rlike("|".join(words))
    top = F.when(has(HISTORY_TOP), "history").when(has(FUTURE_TOP), "future").when(low.isin(*NAVIGATION), "navigation").otherwise("content")
    return F.when(level == 2, top).otherwise(F.when(has(HISTORY_DEEP), "history").when(has(FUTURE_DEEP), "future"))


def outline(headings: Column) -> Column:
    """Of an array of headings (level, heading): (path, level, section_type) of each, one fold with the headings it stands under.

    The fold runs by blocks of BLOCK headings, as a step copies what its block has
    so far: the work is linear in the headings.
    """
    none = F.array().cast(OUTLINE)

    def state_of(stack: Column, kind: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), kind.alias("kind"), out.alias("out"))

    def step(state: Column, h: Column) -> Column:
        own = F.struct(h["level"].cast("int").alias("level"), h["heading"].alias("heading"))
        stack = F.concat(F.filter(state["stack"], lambda s: s["level"] < h["level"]), F.array(own))
        kind = F.coalesce(section_mark(h["level"], h["heading"]), state["kind"])
        named = F.struct(F.array_join(stack["heading"], " > ").alias("path"), h["level"].cast("int").alias("level"), kind.alias("section_type"))
        return state_of(stack, kind, F.concat(state["out"], F.array(named)))

    def block(state: Column, some: Column) -> Column:
        return _let(F.aggregate(some, state_of(state["stack"], state["kind"], none), step), lambda s: state_of(s["stack"], s["kind"], F.concat(state["out"], F.array(s["out"]))))

    empty = state_of(F.array().cast("array<struct<level:int,heading:string>>"), F.lit("content"), F.array().cast(f"array<{OUTLINE}>"))
    blocks = _let(headings, lambda h: F.transform(F.sequence(F.lit(0), F.size(h), F.lit(BLOCK)), lambda first: F.slice(h, first + 1, F.lit(BLOCK))))
    return F.aggregate(blocks, empty, block, lambda state: F.flatten(state["out"]))


def _root(nodes: Column) -> Column:
    """(at, until) of the wiki's content element (the one of the page before one in a badge), else main, article or body."""
    inner = lambda n: _fits(n, "div.mw-parser-output")

    def best(outer: Column) -> Column:
        found = F.filter(nodes, lambda n: inner(n) | n["tag"].isin("main", "article", "body"))
        rank = lambda n: F.when(inner(n) & (n["parent"] == outer["at"]), 0).when(inner(n), 1).when(n["tag"] == "main", 2).when(n["tag"] == "article", 3).otherwise(4)
        return F.array_min(F.transform(found, lambda n: F.struct(rank(n).alias("rank"), n["at"].alias("at"), n["until"].alias("until"))))

    return _let(_first(nodes, lambda n: _fits(n, "div#mw-content-text")), best)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", site: str = SITE, resolve: Callable[[str], str] = html.unescape, empty: bool = False) -> DataFrame:
    """(key, title, sections, infobox, tables, images, hrefs, categories, word_count, error) of every page.

    A page that is null or empty, cannot be parsed or has no content element has
    an error and empty lists. Repeated pages give a row each. resolve is what
    resolves the entities of texts, by HTML's rules if no other is given; empty
    keeps sections with a heading and no text.
    """
    nodes = F.col("nodes")
    rooted = elements(pages, key, page, resolve).withColumn("root", _root(nodes))
    bare = _Page(nodes, F.col("root"))
    box = _first(bare.inside(bare.root), lambda n: (_fits(n, "div.infobox") | _fits(n, "div.notaninfobox")) & bare.quiet(n))
    boxed = rooted.withColumn("box", box)
    p = _Page(nodes, F.col("root"), F.col("box"))
    title = F.coalesce(_first(nodes, lambda n: _fits(n, "h1#firstHeading")), _first(nodes, lambda n: n["tag"] == "title"))
    lists = {"sections": p.sections(empty), "infobox": p.infobox(), "tables": p.tables(), "images": p.images(site), "hrefs": p.hrefs(), "categories": p.categories()}
    found = boxed.select(key, p.text(title).alias("title"), *[F.when(p.root.isNotNull(), c).alias(n) for n, c in lists.items()], "error", p.root.isNull().alias("rootless"))
    full = found.select(key, "title", *[F.coalesce(n, F.array().cast(kind)).cast(kind).alias(n) for n, kind in TYPES.items()], F.coalesce("error", F.when(F.col("rootless"), "no content element")).alias("error"))
    said = F.concat(F.col("sections")["text"], F.col("tables"), F.col("infobox")["v"])
    words = F.aggregate(said, F.lit(0).cast("bigint"), lambda n, s: n + _words(s))
    return full.select(key, "title", *TYPES, words.alias("word_count"), "error")


def breadcrumbs(headings: DataFrame, page: str, ordinal: str = "ordinal", level: str = "level", heading: str = "heading") -> DataFrame:
    """Adds path, a heading after those that it stands under, and section_type: one fold over each page's headings."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("i"), F.col(level).alias("level"), F.col(heading).alias("heading"))))
    per = headings.groupBy(page).agg(listed.alias("rows"))
    return per.select(page, F.explode(F.arrays_zip("rows", outline(F.col("rows")).alias("outline"))).alias("r")).select(
        page, F.col("r.rows.i").alias(ordinal), F.col("r.rows.level").alias(level), F.col("r.rows.heading").alias(heading), "r.outline.path", "r.outline.section_type"
    )

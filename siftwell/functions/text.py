"""Text functions as Column expressions, for whole-stage code where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
STUB_WORDS = 50


def clean_text(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def token_count(c: Column) -> Column:
    """Runs of letters and digits: the deterministic default token counter."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("bigint")


def token_estimate(count: Column, text: Column) -> Column:
    """The count, or a quarter of the characters where it is 0 or missing."""
    return F.coalesce(F.nullif(count, F.lit(0)), F.floor(F.length(text) / 4)).cast("bigint")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def query_terms(c: Column) -> Column:
    """Query words of three characters and more; anything but word characters separates; repeats stay."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 2)


def space_tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")


def alpha_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def chunk_id(title: Column, heading: Column, index: Column) -> Column:
    """First 16 hex digits of the md5 of title, heading and index with bars between."""
    return F.substring(F.md5(F.concat_ws("|", title, heading, index.cast("string")).cast("binary")), 1, 16)


def content_hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def is_list_item(line: Column) -> Column:
    return line.rlike(r"^\s*[-*]\s+") | line.rlike(r"^\s*\d+\.\s+")


def sentences(c: Column) -> Column:
    """Cut after . ! ? before white space; blanks trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def is_table_row(line: Column) -> Column:
    return line.startswith("|") & ~line.startswith("|---")


def strip_thinking(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))


def citation_numbers(c: Column) -> Column:
    """Numbers of [n] and [Source n]."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(?:Source\s+)?(\d+)\]"), F.lit(1)), lambda n: n.cast("int"))


def json_object(c: Column) -> Column:
    """The JSON object in a text as a string: the text itself, a fenced block, or its widest braces; null if none parses."""
    whole = F.trim(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)

    def valid(x: Column) -> Column:
        return F.when(x.startswith("{") & F.get_json_object(x, "$").isNotNull(), x)

    return F.coalesce(valid(whole), valid(fenced), valid(braces))


def json_labels(c: Column) -> Column:
    """The first [...] of a text as an array of strings; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)(\[.*?\])", 1), F.lit("")), "array<string>")


def embedding_text(title: Column, heading: Column, text: Column, prefix: str = "") -> Column:
    """Title, the heading as a dash line unless it is a generic one, and the text, a line each."""
    dash = F.when(~heading.isin("Introduction", "Infobox") & (heading != ""), F.concat(F.lit("- "), heading))
    return F.concat(F.lit(prefix), F.concat_ws("\n", title, dash, text))


def query_text(query: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), query)


def collection_name(model: Column) -> Column:
    return F.concat(F.lit("chunks_"), F.translate(model, "/-.", "___"))


def model_folder(model: Column) -> Column:
    return F.translate(model, "/\\", "__")


def cited_text(c: Column) -> Column:
    return F.substring(c, 1, 300)


def description_of(filename: Column) -> Column:
    return F.replace(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def is_meta(title: Column) -> Column:
    """Titles of editions, versions and tooling, which page scores demote."""
    return title.rlike(r"(?i)edition\b|\b1\.\d+|\b\d{2}w\d+[a-z]?|launcher|mojang|protocol|tracker")


def normalized(v: Column) -> Column:
    """A vector divided by its length; a zero vector stays."""
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = F.when(square > 0, F.sqrt(square)).otherwise(1.0)
    return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n)).getItem(0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Colour codes that marked-up tags stand for (fixed values).
TAGS = {"heading": "§6§l", "sub": "§e", "term": "§b", "tip": "§a", "warning": "§c", "note": "§7"}


def expand_tags(c: Column) -> Column:
    """[tag]x[/tag] as the tag's codes, x and a reset; other text stays."""
    for tag, codes in TAGS.items():
        c = F.regexp_replace(c, rf"(?s)\[{tag}\](.*?)\[/{tag}\]", f"{codes}$1§r")
    return c


#: Colours and styles of formatting codes (fixed values).
COLOURS = {
    "0": "#000000", "1": "#0000AA", "2": "#00AA00", "3": "#00AAAA", "4": "#AA0000", "5": "#AA00AA", "6": "#FFAA00", "7": "#AAAAAA",
    "8": "#555555", "9": "#5555FF", "a": "#55FF55", "b": "#55FFFF", "c": "#FF5555", "d": "#FF55FF", "e": "#FFFF55", "f": "#FFFFFF",
}
STYLES = {"l": "font-weight: bold", "o": "font-style: italic", "n": "text-decoration: underline", "m": "text-decoration: line-through"}


def format_spans(c: Column) -> Column:
    """Formatting codes as HTML spans: a fold over the coded pieces, with the colour and the set of styles as state."""
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    pieces = F.split(c, "§")
    start = F.struct(F.get(pieces, F.lit(0)).alias("out"), F.lit("").alias("colour"), F.lit("").alias("styles"))

    def step(state: Column, piece: Column) -> Column:
        code, rest = F.lower(F.substring(piece, 1, 1)), F.substring(piece, 2, 1_000_000_000)
        is_open = (state["colour"] != "") | (state["styles"] != "")
        closed = F.concat(state["out"], F.when(is_open, "</span>").otherwise(""))
        colour = F.coalesce(F.element_at(colours, code), state["colour"])
        styles = F.when(code.isin(*STYLES) & ~F.contains(state["styles"], code), F.concat(state["styles"], code)).otherwise(state["styles"])
        spelt = [F.when(colour != "", F.concat(F.lit("color: "), colour)), *(F.when(F.contains(styles, F.lit(k)), F.lit(v)) for k, v in STYLES.items())]
        opened = F.when((colour != "") | (styles != ""), F.concat(F.lit('<span style="'), F.concat_ws("; ", *spelt), F.lit('">'))).otherwise("")
        plain = F.struct(F.concat(state["out"], rest).alias("out"), state["colour"].alias("colour"), state["styles"].alias("styles"))
        reset = F.struct(F.concat(closed, rest).alias("out"), F.lit("").alias("colour"), F.lit("").alias("styles"))
        styled = F.struct(F.concat(closed, opened, rest).alias("out"), colour.alias("colour"), styles.alias("styles"))
        return F.when(code == "", plain).when(code == "r", reset).otherwise(styled)

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.when((state["colour"] != "") | (state["styles"] != ""), "</span>").otherwise(""))

    return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, step, finish)


def run_stamp() -> Column:
    """The time when the query began, in UTC, as ISO text."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")

"""Chunks of pages: sections to chunks, splitting by structure or characters, merging of small ones."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import DEFAULTS, Settings
from ..shipping import ship

MIN_TOKENS, MAX_TOKENS, OVERLAP, MERGE_BELOW = DEFAULTS.min_tokens, DEFAULTS.max_tokens, DEFAULTS.overlap, DEFAULTS.merge_below
_TOKEN = re.compile(r"[^\W_]+")
_LIST = re.compile(r"\s*(?:[-*]|\d+\.)\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
SEPARATORS = ("\n\n", "\n", " ", "")


def count(text: str) -> int:
    """The same tokens as functions.text.token_count."""
    return len(_TOKEN.findall(text))


def list_blocks(text: str) -> list[tuple[str, bool]]:
    """(block, is it a list): neighbouring lines of the same kind; blank prose lines go."""
    out: list[tuple[list[str], bool]] = []
    for line in text.split("\n"):
        kind = bool(_LIST.match(line))
        if not kind and not line.strip():
            if out and out[-1][1]:
                out.append(([], False))
            continue
        if out and out[-1][1] == kind:
            out[-1][0].append(line)
        else:
            out.append(([line], kind))
    return [("\n".join(lines), kind) for lines, kind in out if lines]


def packed_words(text: str, most: int) -> Iterator[str]:
    """Words packed up to most tokens; a word over that stands alone, whole."""
    held, size = [], 0
    for word in text.split(" "):
        n = count(word)
        if held and (size + n > most):
            yield " ".join(held)
            held, size = [], 0
        if n > most:
            yield word
        else:
            held.append(word)
            size += n
    if held:
        yield " ".join(held)


def split_text(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Sentences and list lines packed up to most tokens.

    Where prose overflows, the last whole sentences of overlap tokens at most
    start the next chunk, as far as the sentence that overflowed still fits beside
    them; where a list line does, nothing is carried over. A unit over most is
    split by words.
    """
    units = [(u, count(u), is_list) for block, is_list in list_blocks(text) for u in (block.split("\n") if is_list else filter(None, map(str.strip, _SENTENCE.split(block))))]
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for unit, n, is_list in units:
        if n > most:
            if held:
                out.append(" ".join(u for u, _ in held))
            out.extend(packed_words(unit, most))
            held = []
            continue
        if held and sum(k for _, k in held) + n > most:
            out.append(" ".join(u for u, _ in held))
            kept, total, room = 0, 0, min(overlap, most - n)
            while not is_list and kept < len(held) and total + held[-1 - kept][1] <= room:
                total += held[-1 - kept][1]
                kept += 1
            held = held[len(held) - kept :] if kept else []
        held.append((unit, n))
    if held:
        out.append(" ".join(u for u, _ in held))
    return out


def split_table(table: str, most: int = MAX_TOKENS) -> list[str]:
    """A Markdown table in pieces of whole rows, each with the header; one row a piece if the header fills the budget."""
    lines = table.strip().split("\n")
    head, rows = lines[:2], lines[2:]
    if len(head) < 2 or not rows:
        return [table]
    budget, pieces, used = most - count("\n".join(head)), [], 0
    for row in rows:
        n = count(row)
        if not pieces or budget <= 0 or used + n > budget:
            pieces.append([])
            used = 0
        pieces[-1].append(row)
        used += n
    return ["\n".join(head + p) for p in pieces]


def split_recursive(text: str, size: int = MAX_TOKENS, overlap: int = OVERLAP, length: Callable[[str], int] = len, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut at the first separator that occurs, parts still too long at the next ones; neighbours are joined up to size, with overlap."""
    used = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, rest = separators[used], separators[used + 1 :]
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out, held = [], []

    def flush() -> None:
        if held and (joined := sep.join(held).strip()):
            out.append(joined)

    for p in parts:
        if length(p) > size:
            flush()
            held = []
            out.extend(split_recursive(p, size, overlap, length, rest) if rest else [p])
            continue
        if held and length(sep.join([*held, p])) > size:
            flush()
            while held and (length(sep.join(held)) > overlap or length(sep.join([*held, p])) > size):
                held.pop(0)
        held.append(p)
    flush()
    return out


def section_chunks(sections: DataFrame, page: str, least: int = MIN_TOKENS, most: int = MAX_TOKENS, overlap: int = OVERLAP, split: Callable[[str, int, int], list[str]] | None = None) -> DataFrame:
    """Chunks of sections (page, ordinal, heading, level, text, section_type and whatever else): adds chunk_index, text, token_count, chunk_id.

    Sections under least tokens go; those within most stay as they are, without
    Python; only longer ones are split in tasks, by sentences unless split says
    otherwise.
    """
    cut = split or split_text
    ship(sections.sparkSession)
    trimmed = sections.withColumn("text", F.trim("text")).withColumn("token_count", T.token_count(F.col("text"))).where((F.col("text") != "") & (F.col("token_count") >= least))
    heading = F.concat(F.col("heading"), F.when(F.col("section_type") == "history", " (history)").otherwise(""))

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("chunk_id", T.chunk_id(F.col(page), heading, F.col("chunk_index")))

    fits = trimmed.where(F.col("token_count") <= most).withColumn("chunk_index", F.lit(0))

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut(x, most, overlap))

    long = trimmed.where(F.col("token_count") > most).withColumn("piece", pieces("text"))
    long = long.select(*[c for c in trimmed.columns if c not in ("text", "token_count")], F.posexplode("piece").alias("chunk_index", "text"))
    long = long.withColumn("token_count", T.token_count(F.col("text")))
    return named(fits).unionByName(named(long))


def split_chunks(rows: DataFrame, key: str, text: str, how: str = "section_aware", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, text) by a strategy: section_aware packs sentences, recursive cuts by separators."""
    ship(rows.sparkSession)
    if how not in STRATEGIES:
        raise ValueError(f"unknown strategy {how}")
    split = STRATEGIES[how]

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split(x or "", most, overlap))

    return rows.select(key, F.posexplode(pieces(F.col(text))).alias("chunk_index", "text"))


STRATEGIES: dict[str, Callable[[str, int, int], list[str]]] = {"section_aware": split_text, "recursive": split_recursive}


def merge_small(chunks: DataFrame, page: str, below: int = MERGE_BELOW, most: int = MAX_TOKENS) -> DataFrame:
    """Runs of small neighbouring chunks of a page and type become one, up to most tokens; adds place, from 0 in each page, and was_small.

    chunks: page, ordinal, heading, text, token_count, chunk_type and whatever else.
    The text is joined by an empty line (tables by a line feed), headings not yet in
    the joined one are added. Of other columns images are joined, a section_type
    becomes content, a chunk_id is made anew from heading and place, and the rest is
    that of the first chunk. That holds for each small chunk, merged or not, but on
    a page of one chunk, which stays as it is. Small chunks are few a page and
    their texts are folded in a task a page; the large ones never enter Python.
    """
    ship(chunks.sparkSession)
    order, whole = Window.partitionBy(page).orderBy("ordinal"), Window.partitionBy(page)
    small = (F.col("token_count") < below) & (F.count("*").over(whole) > 1)
    marked = chunks.withColumn("was_small", small)
    edge = (~F.col("was_small")) | ~F.coalesce(F.lag("was_small").over(order), F.lit(False)) | F.coalesce(F.lag("chunk_type").over(order) != F.col("chunk_type"), F.lit(True))
    runs = marked.withColumn("run", F.sum(edge.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fields = ["ordinal", *[c for c in chunks.columns if c not in (page, "ordinal", "chunk_type")]]
    folded = runs.where("was_small").groupBy(page, "run", "chunk_type").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))

    @F.pandas_udf("array<struct<first: int, n: int, heading: string, text: string, token_count: bigint>>")
    def merged(rows: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for run, kind in zip(rows, kinds):
            between, held = "\n" if kind == "table" else "\n\n", []
            for i, r in enumerate(run):
                last = held[-1] if held else None
                if last is not None and last["token_count"] + r["token_count"] <= most:
                    last["text"] += between + r["text"]
                    last["token_count"] = count(last["text"])
                    last["n"] += 1
                    if r["heading"] not in last["heading"]:
                        last["heading"] += f" + {r['heading']}"
                else:
                    held.append({"first": i, "n": 1, "heading": r["heading"], "text": r["text"], "token_count": r["token_count"]})
            out.append(held)
        return pd.Series(out)

    texts = F.transform("rows", lambda r: F.struct(r["heading"].alias("heading"), r["text"].alias("text"), r["token_count"].cast("bigint").alias("token_count")))
    each = folded.select(page, "chunk_type", "rows", F.explode(merged(texts, "chunk_type")).alias("m"))

    def joined(c: str):
        if c in ("heading", "text", "token_count"):
            return F.col(f"m.{c}").cast(chunks.schema[c].dataType)
        if c == "images":
            return F.flatten(F.transform(F.slice("rows", F.col("m.first") + 1, F.col("m.n")), lambda r: r[c]))
        return F.lit("content") if c == "section_type" else F.get("rows", F.col("m.first"))[c]

    both = each.select(page, "chunk_type", *[joined(c).alias(c) for c in fields], F.lit(True).alias("was_small")).unionByName(runs.where("NOT was_small").drop("run"))
    both = both.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("ordinal")) - 1)
    if "chunk_id" in chunks.columns:
        both = both.withColumn("chunk_id", F.when(F.col("was_small"), T.chunk_id(F.col(page), F.col("heading"), F.col("place"))).otherwise(F.col("chunk_id")))
    return both


def corpus_chunks(sections: DataFrame, page: str, types: DataFrame, related: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Chunks, small neighbours merged, with page_type (default other) and related_pages (default empty) of their page: two left joins."""
    chunks = section_chunks(sections, page, settings.min_tokens, settings.max_tokens, settings.overlap, STRATEGIES[settings.chunker])
    chunks = chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy(page).orderBy("ordinal", "chunk_index")) - 1).drop("chunk_index")
    if "chunk_type" not in chunks.columns:
        chunks = chunks.withColumn("chunk_type", F.lit("section"))
    chunks = merge_small(chunks, page, settings.merge_below, settings.max_tokens).drop("was_small", "ordinal").withColumnRenamed("place", "ordinal")
    out = chunks.join(types.select(page, "page_type"), page, "left").join(related.select(page, "related_pages"), page, "left")
    return out.withColumn("page_type", F.coalesce("page_type", F.lit("other"))).withColumn("related_pages", F.coalesce("related_pages", F.array().cast("array<string>")))

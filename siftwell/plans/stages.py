"""Stages of the corpus build, in order: each writes a table that the next ones read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .. import config
from ..operators import chunking, classify, fulltext, graph, html
from ..operators.quality import keep_first
from ..settings import DEFAULTS, Settings
from ..sources.tables import populated

Stage = Callable[[SparkSession, str, Settings], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def _clean(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    """raw (title, url, html) -> pages_clean."""
    raw = _table(spark, folder, "raw")
    found = html.extract(raw, "url").withColumnRenamed("title", "page_title")
    return raw.select("url", "title").join(found, "url").withColumn("is_stub", F.col("word_count") < T.STUB_WORDS)


def _classify(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    return classify.classified(_table(spark, folder, "pages_clean").select("title", "categories"), "categories")


def _links(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    pages = _table(spark, folder, "pages_clean")
    titles = F.filter(F.transform("hrefs", lambda h: U.href_to_title(h)), lambda t: t.isNotNull())
    edges = pages.select("title", F.posexplode(F.slice(F.array_distinct(titles), 1, graph.MAX_LINKS)).alias("ordinal", "target"))
    return graph.graph(edges, pages, "title")


def _chunk(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    pages = _table(spark, folder, "pages_clean")
    filled = F.filter("infobox", lambda p: p["v"] != "")
    box = F.array_join(F.transform(filled, lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "\n")
    shown = F.filter("images", lambda i: i["context_type"] == "infobox").alias("images")
    boxes = pages.where(F.size("infobox") > 0).select("title", "url", F.lit(-1).alias("ordinal"), F.lit("Infobox").alias("heading"), F.lit(0).alias("level"), box.alias("text"), F.lit("content").alias("section_type"), F.lit("infobox").alias("chunk_type"), shown)
    shown = F.filter("images", lambda i: i["section"] == F.col("s.heading")).alias("images")
    sections = pages.select("title", "url", "images", F.posexplode("sections").alias("ordinal", "s")).select("title", "url", "ordinal", "s.heading", "s.level", "s.text", "s.section_type", F.lit("section").alias("chunk_type"), shown)
    related = graph.adjacency(_table(spark, folder, "links"), "title").withColumnRenamed("targets", "related_pages")
    return chunking.corpus_chunks(boxes.unionByName(sections), "title", _table(spark, folder, "classified"), related, settings)


def _embed(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    chunks = keep_first(_table(spark, folder, "chunks"), "chunk_id", ["title", "url", "ordinal"])
    text = T.embedding_text(F.col("title"), F.col("heading"), F.col("text"))
    return config.embedder(settings.embedder)(chunks.select("chunk_id", text.alias("text")), "chunk_id", "text", settings.dimension)


def _index(spark: SparkSession, folder: str, settings: Settings) -> DataFrame:
    return fulltext.postings(_table(spark, folder, "chunks"), "chunk_id", "text")


STAGES: dict[str, tuple[str, Stage]] = {
    "clean": ("pages_clean", _clean), "classify": ("classified", _classify), "links": ("links", _links),
    "chunk": ("chunks", _chunk), "embed": ("vectors", _embed), "index": ("postings", _index),
}


#: The tables that each stage reads.
INPUTS = {"clean": ("raw",), "classify": ("pages_clean",), "links": ("pages_clean",), "chunk": ("pages_clean", "classified", "links"), "embed": ("chunks",), "index": ("chunks",)}


def rows_hash(rows: DataFrame) -> str:
    """A hash of a table's rows in any order: their number, and the sum and the exclusive or of their hashes."""
    h = rows.select(F.xxhash64(*[F.to_json(F.col(c)) if "map<" in kind else F.col(c) for c, kind in rows.dtypes]).alias("h"))
    n, total, mixed = h.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.expr("bit_xor(h)")).first()
    return f"{','.join(f'{c} {kind}' for c, kind in rows.dtypes)}|{n}|{total}|{mixed}"


def code_version() -> str:
    """A hash of the package's sources that stages are made of."""
    home = Path(__file__).resolve().parent.parent
    files = sorted(p for d in (".", "functions", "operators", "plans", "sources") for p in (home / d).glob("*.py"))
    return hashlib.sha256(b"".join(p.name.encode() + p.read_bytes() for p in files)).hexdigest()


def state(spark: SparkSession, folder: str, name: str, settings: Settings) -> dict[str, str]:
    """What a stage's table depends on: rows of its inputs, settings, code."""
    inputs = {t: rows_hash(_table(spark, folder, t)) for t in INPUTS[name]}
    return {"inputs": json.dumps(inputs, sort_keys=True), "settings": repr(settings), "code": code_version()}


def unchanged(spark: SparkSession, folder: str, name: str, now: dict[str, str]) -> bool:
    """Whether a stage's table is there and was made from just this state."""
    where = f"{folder}/manifests/{name}"
    if not (populated(spark, f"{folder}/{STAGES[name][0]}", 0) and populated(spark, where)):
        return False
    return spark.read.parquet(where).first().asDict() == now


def run(spark: SparkSession, folder: str, start: str | None = None, only: str | None = None, skip_populated: bool = False, settings: Settings = DEFAULTS, skip_unchanged: bool = False) -> list[str]:
    """Runs all stages, those from start on, or only one, under the settings; returns the names of those that ran.

    skip_populated skips stages whose table has rows. skip_unchanged skips those
    whose table was made from the same input rows, settings and code, by the
    manifest written after it.
    """
    config.chunker(settings.chunker), config.embedder(settings.embedder)  # unknown names are refused before anything runs
    for name in (start, only):
        if name is not None and name not in STAGES:
            raise ValueError(f"unknown stage {name}")
    names = list(STAGES)
    names = [only] if only else names[names.index(start) :] if start else names
    ran = []
    for name in names:
        table, stage = STAGES[name]
        if skip_populated and populated(spark, f"{folder}/{table}"):
            continue
        now = state(spark, folder, name, settings) if skip_unchanged else None
        if now and unchanged(spark, folder, name, now):
            continue
        stage(spark, folder, settings).write.mode("overwrite").parquet(f"{folder}/{table}")
        if now:
            spark.createDataFrame([tuple(now.values())], ", ".join(f"{k} string" for k in now)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/{name}")
        ran.append(name)
    return ran

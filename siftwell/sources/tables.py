"""Readers and sinks: sitemaps, HTML files, JSON, vectors, keyed upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

QUESTION = "question string, answer string, difficulty string, relevant_links array<string>, relevant_images array<struct<url string, local_filename string>>, source_page string, generator_model string, generated_at string"
IMAGE = "local_filename string, original_url string, file_path string, file_size_bytes bigint, width int, height int, format string, scraped_at string, source_pages array<string>"
MIN_PIXELS = 150


def sitemap_index(spark: SparkSession, path: str, namespaces: tuple[str, ...] = ("NS_0",)) -> DataFrame:
    """(url) of child sitemaps whose address names an allowed namespace."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    keep = F.lit(False)
    for n in namespaces:
        keep = keep | F.contains("loc", F.lit(n))
    return rows.where(keep).select(F.trim("loc").alias("url"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a sitemap's pages (gzip by its suffix) that a crawl may take."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("url")).where(U.allowed(F.col("url")))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(clean_path, html): whole files, named without their folder."""
    files = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("clean_path"), F.col("value").alias("html"))


def page_metadata(pages: DataFrame, extracted: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """What a fetch notes of each page: title, words, categories, hash of the bytes, file name."""
    return pages.join(extracted.select(key, "title", "word_count", "categories"), key).select(
        key, url, "title", "word_count", "categories", T.content_hash(F.col(html)).alias("content_hash"), U.path_to_filename(F.col(url)).alias("file_path")
    )


def questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A question set, a list or {items: [...]}, in its order; limit takes the first ones."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    root, items = F.from_json("v", f"array<struct<{_fields(QUESTION)}>>"), F.from_json("v", f"struct<items: array<struct<{_fields(QUESTION)}>>>")
    each = text.select(F.posexplode(F.when(F.trim("v").startswith("["), root).otherwise(items["items"])).alias("ordinal", "q")).select("ordinal", "q.*")
    return each.orderBy("ordinal").limit(limit) if limit else each


def _fields(ddl: str) -> str:
    return ddl.replace(" string", ": string").replace(" array<", ": array<").replace(" int", ": int").replace(" bigint", ": bigint").replace(" struct<", ": struct<")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, with a declared schema."""
    return spark.read.schema(schema).json(path)


def documents_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def wanted_images(images: DataFrame) -> DataFrame:
    """Images that are no decoration and not too small."""
    return images.where(~U.is_decoration(F.col("original_url")) & (F.col("width") >= MIN_PIXELS) & (F.col("height") >= MIN_PIXELS))


def missing_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """Image rows whose file is not among files(file_path)."""
    return images.join(files.select("file_path"), "file_path", "left_anti")


def upserted(rows: DataFrame, key: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """One row a key, the first by order; rows of existing go before and are replaced."""
    fresh = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    if existing is None:
        return fresh
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def flat_metadata(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Nested columns as JSON text, nulls as empty text; the columns of keep stay."""
    out = []
    for f in rows.schema:
        kind = f.dataType.typeName()
        if f.name in keep:
            out.append(F.col(f.name))
        elif kind in ("array", "map", "struct"):
            out.append(F.coalesce(F.to_json(f.name), F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return rows.select(*out)


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors as Parquet, a folder for each model and chunker, so that a search reads one of them; other models' and chunkers' stay when one is written anew."""
    parts = [c for c in ("model", "chunker") if c in vectors.columns]
    writer = vectors.write.mode(mode)
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*parts) if parts else writer).parquet(path)


def populated(spark: SparkSession, path: str, least: int = 1) -> bool:
    """Whether a table is there with so many rows: what decides if a stage is skipped."""
    try:
        return spark.read.parquet(path).limit(least).count() >= least
    except Exception as e:  # an absent or empty folder has no schema
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def markdown_report(summary: DataFrame, columns: list[str], decimals: int = 3, most: int = 10_000) -> str:
    """A summary table of a few rows in Markdown, numbers with three decimals; a table of more than most rows is refused."""
    rows = summary.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows are no summary")
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    shown = [[f"{v:.{decimals}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in rows]
    return "\n".join(head + ["| " + " | ".join(r) + " |" for r in shown])


def write_json(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Rows as JSON lines over what was there; files bounds the number of files, 1 for a report of few rows."""
    (rows.coalesce(files) if files else rows).write.mode("overwrite").json(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a table; 0 for one that is not there."""
    return spark.read.parquet(path).count() if populated(spark, path) else 0


def reset(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table with this schema in place of what was there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def stamped(rows: DataFrame, column: str = "scraped_at") -> DataFrame:
    """rows with the time of the run, the same in all of them."""
    return rows.withColumn(column, T.run_stamp())

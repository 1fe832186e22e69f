"""Queries of audits, profiles, keyed tables and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, quality
from ..sources import tables
from ..streaming import incremental
from .registry import query, table

COUNT = r"len(regexp_extract_all(text, '[\p{L}\p{N}]+'))"
SIZES = f"sizes AS (SELECT doc_id, lang, source, text, {COUNT}::BIGINT AS n FROM documents)"


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("n", T.token_count(F.col("text")))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", T.content_hash(F.col("text")).alias("h"))
    return rows.groupBy("h").agg(F.min_by(F.struct("doc_id", "source"), "doc_id").alias("r")).select("r.doc_id", "r.source")


@query("SELECT md5(text) AS h, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))
    return quality.keep_last(rows, "h", "doc_id").select("h", "doc_id")


TFIDF = r"""reps AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents GROUP BY md5(text)),
    tf AS (SELECT doc_id, term, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM reps) GROUP BY ALL),
    n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), idf AS (SELECT term, ln((any_value(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM tf, n GROUP BY term),
    raw AS (SELECT doc_id, term, k * idf AS v FROM tf JOIN idf USING (term)), norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM raw GROUP BY doc_id),
    w AS (SELECT doc_id, term, v / norm AS w FROM raw JOIN norms USING (doc_id))"""


@query(f"WITH {TFIDF} SELECT a, b, score FROM (SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.w * y.w), 6) AS score FROM w x JOIN w y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL) WHERE score >= 0.82")
def near_duplicates_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of class representatives; class_members gives the classes."""
    return quality.similar_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS class FROM documents")
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classes(table(spark, sf_dir, "documents"), "doc_id", "text")


QUESTIONS = r"""questions AS (
    SELECT c.conv_id * 100 + c.turn AS qid, c.role, text AS answer, CASE WHEN turn % 3 = 0 THEN 'easy' WHEN turn % 3 = 1 THEN 'hard' ELSE 'unknown' END AS difficulty,
        len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))::BIGINT AS words FROM conversations c)"""
FLAGS = f"""{QUESTIONS}, flags AS (
    SELECT 'short_answer' AS "check", qid FROM questions WHERE words < CASE difficulty WHEN 'hard' THEN 40 ELSE 8 END
    UNION ALL SELECT 'missing_links', qid FROM questions WHERE role = 'system' UNION ALL SELECT 'title_verbatim', qid FROM questions WHERE contains(lower(answer), lower(role)))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("turn") % 3 == 0, "easy").when(F.col("turn") % 3 == 1, "hard").otherwise("unknown")
    links = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array("role"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), "role", F.col("text").alias("answer"), d.alias("difficulty"), links.alias("links"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir)
    return quality.flags(
        {"short_answer": quality.short_answers(q), "missing_links": quality.missing_links(q, "links"), "title_verbatim": q.where(quality.verbatim_title(F.col("role"), F.col("answer")))}, "qid"
    )


@query(f'WITH {FLAGS} SELECT "check", qid FROM flags')
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


@query(f'WITH {FLAGS} SELECT "check", count(DISTINCT qid) AS n, round(100.0 * count(DISTINCT qid) / (SELECT count(*) FROM questions), 4) AS pct FROM flags GROUP BY "check"')
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_summary(_flags(spark, sf_dir), "qid", questions(spark, sf_dir).count())


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower(b.text) = lower(c.text))")
def new_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").withColumnRenamed("text", "question")
    return quality.new_questions(asked, table(spark, sf_dir, "benchmark").withColumnRenamed("text", "question")).select("conv_id", "turn")


@query(f"WITH {SIZES} SELECT low, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM sizes), 4) AS pct FROM (SELECT CASE WHEN n >= 1024 THEN 1024 WHEN n >= 512 THEN 512 WHEN n >= 256 THEN 256 WHEN n >= 100 THEN 100 WHEN n >= 50 THEN 50 WHEN n >= 10 THEN 10 ELSE 0 END AS low FROM sizes) GROUP BY low")
def chunk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(sized(spark, sf_dir), "n")


@query(f"WITH {SIZES} SELECT doc_id, n FROM sizes WHERE n > 512 ORDER BY n DESC, doc_id LIMIT 10")
def outliers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest: a top-k report."""
    return metrics.largest(sized(spark, sf_dir).select("doc_id", "n"), "n", "doc_id", 512)


@query(f"WITH {SIZES} SELECT source, sum(k)::BIGINT AS n_small, string_agg(lang || '=' || k, ',' ORDER BY lang || '=' || k) AS kinds FROM (SELECT source, lang, count(*) AS k FROM sizes WHERE n < 100 GROUP BY ALL) GROUP BY source HAVING sum(k) >= 5")
def small_groups_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.small_groups(sized(spark, sf_dir), "source", "lang", "n", 100, 5)


@query("SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS text_bytes, (count(*) * 768 * 4)::BIGINT AS vector_bytes FROM documents GROUP BY ROLLUP (lang)")
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.storage(table(spark, sf_dir, "documents"), "lang", "text")


@query("SELECT lang, count(DISTINCT source) AS n FROM documents GROUP BY lang")
def distinct_pages_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n"))


@query(f"WITH {SIZES} SELECT lang, count(*) AS n, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM sizes GROUP BY lang".replace("count(*) AS n, min(n)", "count(*) AS rows, min(n)"))
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def semi_join_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.known_only(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT DISTINCT e.vec_id FROM embeddings e ANTI JOIN labels l ON e.vec_id = l.doc_id")
def orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "embeddings").select(F.explode(F.array("vec_id")).alias("vec_id")).distinct()
    return quality.missing(refs, "vec_id", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT round(100.0 * count(*) FILTER (l.doc_id IS NULL) / count(*), 4) AS missing_pct, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def image_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of rows without a counterpart, as an audit of files reports it."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    absent = tables.missing_files(d.withColumnRenamed("doc_id", "file_path"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_path"))
    n = d.agg(F.count("*").alias("n"))
    return absent.agg(F.count("*").alias("m")).crossJoin(n).select(F.round(100.0 * F.col("m") / F.col("n"), 4).alias("missing_pct"), "n")


@query("SELECT md5(text) AS id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def upsert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed rows over those already there: the first of each key replaces them."""
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("id"), "doc_id")
    before = rows.where("doc_id % 2 = 1").groupBy("id").agg(F.max("doc_id").alias("doc_id"))
    return tables.upserted(rows, "id", "doc_id", before)


@query("SELECT doc_id::VARCHAR AS id, coalesce(lang, '') AS lang, '[\"' || source || '\"]' AS tags FROM documents")
def flat_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.array("source").alias("tags"))
    return tables.flat_metadata(rows, ["id"])


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 50 = 0)")
def incremental_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return incremental.new_rows(e, e.where("event_type = 'purchase' AND event_id % 50 = 0").select("user_id").distinct(), "user_id").select("event_id", "user_id")


@query("SELECT CAST(time_bucket(INTERVAL '1 minute', ts) AS TIMESTAMP) AS window_start, user_id, count(*) AS n FROM events GROUP BY ALL")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.request_windows(table(spark, sf_dir, "events"), "ts", "user_id")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 3")
def rate_limit_exceeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.over_limit(table(spark, sf_dir, "events"), "ts", "event_type", 3, "1 hour")


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, time_bucket(INTERVAL '1 hour', ts) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def requests_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of each kind in each hour pass, the rest are refused; the stream form is tested against this one."""
    return incremental.admitted(table(spark, sf_dir, "events"), "ts", "event_type", "event_id", 3, "1 hour").select("event_id", "event_type", "admitted")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by("event_id", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(first.alias("event_id"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.array("event_type").alias("kinds"))
    out = incremental.merged_sets(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "kinds")
    return out.select("user_id", F.array_join("kinds", ",").alias("kinds"))

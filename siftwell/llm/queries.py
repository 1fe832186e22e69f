"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, language_id, licenses, media, mixing, packing, resample, simhash, token_counts, toxicity, url_filter, warc
from .common import table

#: host, path, verdict (the contract's rules).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: its licences by name, and each match as licence:kind@start-stop."""
    found = licenses.licence_matches(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat(m["license"], F.lit(":"), m["kind"], F.lit("@"), m["start"].cast("string"), F.lit("-"), m["stop"].cast("string")))
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"), F.size("matches").cast("bigint").alias("n_matches"), F.array_join(spans, ",").alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.profiles(docs))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media.from_media(media.to_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(
        "page_id", "kind", "record_id", "refers_to", "target_uri", "block_digest", "n_bytes", "n_links",
        F.length("record").cast("bigint").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), "error",
    )


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_token_counts, op2_license_scan, op3_decontamination, op4_language_id, op5_toxicity,
    op6_simhash, op7_media, op8_url_filter, op9_packing, op10_warc_derivatives,
    op11_source_mixing, op12_collocations, op13_importance_resampling,
)}

ORACLES = {
    "op8_url_filter": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fits AS (
            SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS n
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        )
        SELECT parts.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND n = 1
    """,
    "op11_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || doc_id) AS h FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
        ), w AS (
            SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::HUGEINT AS weight FROM s
        ), levels AS (
            SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER before, 0) AS rest,
                   2 * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS over
            FROM w WINDOW before AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (
            SELECT arg_max(rest, over) AS rest, max(over) AS over FROM levels WHERE rest * weight <= over * 2 * source_size
        ), t AS (
            SELECT source, source_size, CASE WHEN levels.rest * weight > levels.over * 2 * source_size THEN (2 * source_size)::DOUBLE ELSE (level.rest * weight)::DOUBLE / level.over::DOUBLE END AS target,
                   CASE WHEN levels.rest * weight > levels.over * 2 * source_size THEN 2 * source_size ELSE level.rest * weight // level.over END AS words
            FROM levels, level
        ), p AS (
            SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id) - d.size AS begin_at FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CASE WHEN size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(begin_at + size, words % source_size) - begin_at) END::BIGINT AS taken FROM p
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), lists AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists), (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
        ), totals AS (
            SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang
        ), cuts AS (
            SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1 :], ' ') AS rest
            FROM f, (SELECT unnest([1, 2, 3, 4]) AS c) WHERE c < k
        ), each AS (
            SELECT cuts.*, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals ON totals.lang = cuts.lang
        ), best AS (
            SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        ), kept AS (
            SELECT * FROM best WHERE NOT EXISTS (
                SELECT 1 FROM f WHERE f.lang = best.lang AND f.k > best.k AND contains(' ' || f.phrase || ' ', ' ' || best.phrase || ' ') AND 100 * f.f >= 100 * a)
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
        FROM kept QUALIFY rank <= 2000
    """,
}

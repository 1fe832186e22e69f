"""Queries of the search path: keyword and vector legs, fusion, context, citations, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, fulltext, fusion, metrics, postings, vector_index, vectors
from ..operators.kept import kept
from .registry import query, table

ALPHAS = (0.5, 0.6, 0.7, 0.8, 0.9)
KINDS = (1, 3, 5)
#: Bytes of passages, and of a row beside its passage, that are broadcast at once.
PASSAGE_BYTES, ROW_BYTES = 64_000_000, 64

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = rf"""
    asked AS (
        SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS term FROM benchmark
        ) GROUP BY ALL
    ), words AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    lens AS (SELECT doc_id, len({WORDS}) AS len FROM documents),
    totals AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
    idfs AS (SELECT term, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(mean) AS mean FROM tf, totals GROUP BY term),
    bm AS (
        SELECT item_id, doc_id, round(-sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS rank_score
        FROM tf JOIN idfs USING (term) JOIN lens USING (doc_id) JOIN asked USING (term) GROUP BY ALL
    ), kw AS (
        SELECT * FROM (SELECT item_id, doc_id, abs(rank_score) AS score, row_number() OVER (PARTITION BY item_id ORDER BY rank_score, doc_id) AS rank FROM bm) WHERE rank <= 15
    )"""
SEMANTIC = """
    sem AS (
        SELECT * FROM (
            SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
                SELECT b.item_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
                FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v
            )
        ) WHERE rank <= 20
    )"""
FUSED = """
    pooled AS (
        SELECT coalesce(s.item_id, k.item_id) AS item_id, coalesce(s.doc_id, k.doc_id) AS doc_id, s.rank AS sem_rank, k.rank AS kw_rank, s.score AS semantic_score, k.score AS keyword_score
        FROM sem s FULL JOIN kw k ON s.item_id = k.item_id AND s.doc_id = k.doc_id
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, sem_rank IS NULL, coalesce(sem_rank, kw_rank), doc_id) AS rank FROM (
            SELECT *, round(coalesce(0.8 / (20 + sem_rank), 0) + coalesce(0.2 / (20 + kw_rank), 0), 8) AS rrf_score FROM pooled
        )
    ), top AS (SELECT * FROM ranked WHERE rank <= 10)"""


_INDEXES: dict[tuple, postings.Index] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """The files of a table with their sizes and times of change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in found))


def stored_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> postings.Index:
    """The keyword index of documents, built once for a table as it is and read by all searches of the session."""
    known = (spark.sparkContext.applicationId, stemmed, _state(spark, f"{sf_dir}/documents.parquet"))
    if known not in _INDEXES:
        _INDEXES[known] = postings.build(table(spark, sf_dir, "documents"), "doc_id", "text", stemmed=stemmed)
    return _INDEXES[known]


def keyword_leg(spark: SparkSession, sf_dir: str, k: int = fusion.KEYWORD_CANDIDATES, stemmed: bool = False) -> DataFrame:
    """(item_id, doc_id, score, rank): BM25 of documents for each benchmark text, by plain words or by stems."""
    found = postings.search(stored_index(spark, sf_dir, stemmed), table(spark, sf_dir, "benchmark"), "item_id", "text", k, digits=6)
    return found.select("item_id", "doc_id", "score", "rank")


def semantic_leg(spark: SparkSession, sf_dir: str, k: int = fusion.CANDIDATES) -> DataFrame:
    """(item_id, doc_id, score, rank): cosine neighbours of the vector with each benchmark item's id."""
    v = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").join(v, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors.neighbours(v, asked, k)
    return found.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "score", "rank")


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused(semantic_leg(spark, sf_dir), keyword_leg(spark, sf_dir), "item_id", "doc_id")


@query(f"WITH {BM25} SELECT item_id, doc_id, rank, score FROM kw")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_leg(spark, sf_dir).select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query()
def bm25_stemmed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search over stems without accents, words of several parts as phrases; tested against SQLite full text."""
    scored = fulltext.bm25_stemmed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    scored = scored.withColumn("rank_score", F.round("rank_score", 6))
    top = fulltext.top_k(scored, "item_id", [F.asc("rank_score"), F.asc("doc_id")], fusion.KEYWORD_CANDIDATES)
    return top.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.abs("rank_score").alias("score"))


@query(rf"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents) GROUP BY term""")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(rf"SELECT count(*) AS docs, sum(n)::BIGINT AS words, round(avg(n), 6) AS mean_len FROM (SELECT len({WORDS}) AS n FROM documents)")
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = fulltext.lengths(table(spark, sf_dir, "documents"), "doc_id", "text")
    return size.agg(F.count("*").alias("docs"), F.sum("len").alias("words"), F.round(F.avg("len"), 6).alias("mean_len"))


def _knn(where: str = "TRUE", k: int = 20) -> str:
    return f"""
        SELECT query_id, vec_id, score, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
                SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
                FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0 AND {where}
            )
        ) WHERE rank <= {k}"""


def _asked(v: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(_knn())
def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(v, _asked(v), 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(_knn("v.label IN (1, 3, 5)", 10))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind filter is pushed to the scan, before any distance."""
    v = table(spark, sf_dir, "embeddings")
    return vectors.neighbours(v.where(F.col("label").isin(*KINDS)), _asked(v), 10).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours through codes of a byte for two numbers: every row is indexed, a test holds its recall against the exact search."""
    v = table(spark, sf_dir, "embeddings")
    centroids = vector_index.fit(v)
    return vector_index.search(kept(vector_index.coded(v, centroids), "codes"), centroids, v, _asked(v), 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {BM25}, {SEMANTIC}, {FUSED} SELECT item_id, doc_id, rank, rrf_score, semantic_score, keyword_score FROM top")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "rrf_score", "semantic_score", "keyword_score")


@query(f"""WITH {BM25}, {SEMANTIC}, parts AS (
        SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS rrf_score FROM (SELECT item_id, doc_id, rank FROM sem UNION ALL SELECT item_id, doc_id, rank FROM kw) GROUP BY ALL
    ) SELECT item_id, doc_id, rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf_score DESC, doc_id) AS rank FROM parts) WHERE rank <= 10""")
def rrf_plain_k60(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.plain_fused([semantic_leg(spark, sf_dir), keyword_leg(spark, sf_dir)], "item_id", "doc_id")
    return out.select("item_id", "doc_id", "rrf_score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {BM25}, {SEMANTIC}, {FUSED}
    SELECT t.item_id, t.doc_id, t.rank, t.rrf_score, d.lang, e.label, substr(d.text, 1, 300) AS cited_text
    FROM top t JOIN documents d USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = t.doc_id""")
def hybrid_search_hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: both legs, fusion, and the texts of the first ten alone."""
    top = kept(hybrid(spark, sf_dir).select("item_id", "doc_id", "rank", "rrf_score"), "top")  # written, so that counting it does not search again
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    kinds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    out = fusion.hydrated(fulltext.bounded(top), docs, "doc_id").join(kinds, "doc_id", "left")
    return out.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "rrf_score", "lang", "label", T.cited_text(F.col("text")).alias("cited_text"))


@query(f"""WITH {BM25}, {SEMANTIC}, {FUSED}
    SELECT item_id, doc_id, rank, coalesce(e.label::VARCHAR, 'other') AS kind FROM top t LEFT JOIN embeddings e ON e.vec_id = t.doc_id WHERE coalesce(e.label::VARCHAR, 'other') IN ('1', '3', '5')""")
def hybrid_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind filter of fused results comes after the cut, so fewer than ten can be left."""
    top = kept(hybrid(spark, sf_dir).select("item_id", "doc_id", "rank"), "top")
    kinds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("page_type"))
    out = fusion.hydrated(fulltext.bounded(top), kinds, "doc_id", list(KINDS))  # a row without a kind is none of these kinds
    return out.select("item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.col("page_type").cast("string").alias("kind"))


@query(f"""WITH {BM25}, {SEMANTIC}
    SELECT 'semantic' AS mode, item_id, doc_id, rank, score FROM sem WHERE rank <= 10 UNION ALL SELECT 'keyword', item_id, doc_id, rank, score FROM kw WHERE rank <= 10""")
def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sem, kw = semantic_leg(spark, sf_dir), keyword_leg(spark, sf_dir)
    parts = [fusion.search(m, sem, kw, "item_id", "doc_id").select(F.lit(m).alias("mode"), "item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "score") for m in ("semantic", "keyword")]
    return parts[0].unionByName(parts[1])


SOURCES = f"""{BM25}, rows AS (
        SELECT k.item_id, k.rank, d.doc_id, d.source, d.lang, d.text, coalesce(nullif(0, 0), floor(length(d.text) / 4))::BIGINT AS tokens FROM kw k JOIN documents d USING (doc_id)
    ), kept AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM rows) WHERE running <= 3000)"""


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = kept(keyword_leg(spark, sf_dir).select("item_id", "doc_id", "rank"), "top")
    rows = table(spark, sf_dir, "documents").join(fulltext.bounded(top), "doc_id")
    return context.within_budget(rows.withColumn("tokens", T.token_estimate(F.lit(0), F.col("text"))), "item_id")


@query(f"""WITH {SOURCES} SELECT item_id, count(*) AS n_sources, max(running)::BIGINT AS tokens,
    md5(string_agg('[Source ' || rank || ']' || chr(10) || 'Page: ' || source || chr(10) || 'Section: ' || lang || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5 FROM kept GROUP BY item_id""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = context.source_block(F.col("rank"), F.col("source"), F.col("lang"), F.col("text"))
    texts = context.joined(_budgeted(spark, sf_dir), "item_id", block, more=[F.count("*").alias("n_sources"), F.max("running").alias("tokens")])
    return texts.select("item_id", "n_sources", "tokens", F.md5("context").alias("context_md5"))


@query(f"""WITH {SOURCES} SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS id, source AS page_title, replace('https://wiki.example.org/w/' || source, ' ', '_') AS page_url, lang AS section, substr(text, 1, 300) AS cited_text FROM kept""")
def citations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.urls import title_to_url

    rows = _budgeted(spark, sf_dir).select("item_id", "rank", F.col("source").alias("page_title"), title_to_url(F.col("source")).alias("page_url"), F.col("lang").alias("section_heading"), "text")
    return context.citations(rows, "item_id").withColumn("id", F.col("id").cast("bigint"))


@query(f"WITH {BM25} SELECT item_id, md5(string_agg('[Source ' || rank || ']' || chr(10) || 'Page: ' || source || chr(10) || 'Section: ' || lang || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5 FROM kw JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY item_id")
def eval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyword_leg(spark, sf_dir).where("rank <= 5").select("item_id", "doc_id", "rank").join(table(spark, sf_dir, "documents"), "doc_id")
    block = context.source_block(F.col("rank"), F.col("source"), F.col("lang"), F.col("text"))
    return context.joined(rows, "item_id", block).select("item_id", F.md5("context").alias("context_md5"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, wanted): documents in which a benchmark text stands word for word, found through its rarest word.

    The index says which word that is and which documents hold it; the rest of the
    text is compared in the join's condition. Candidates are sent to the documents,
    a pass for each PASSAGE_BYTES of them, so that no document is shuffled.
    """
    docs, items, index = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stored_index(spark, sf_dir)
    asked = items.select("item_id", F.col("text").alias("passage"), F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    rare = asked.join(postings.weights(index, asked), "term").groupBy("item_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.first("passage").alias("passage"))
    found = kept(postings.documents_of(index, rare).select("item_id", "passage", "doc_id"), "gold-candidates")
    passes = max(1, -(-(found.agg(F.sum(F.octet_length("passage") + ROW_BYTES)).first()[0] or 0) // PASSAGE_BYTES))
    out = None
    for nth in range(passes):
        own = found if passes == 1 else found.where(F.pmod(F.xxhash64("item_id", "doc_id"), F.lit(passes)) == nth)
        met = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").where(F.contains("text", F.col("passage"))).select("item_id", F.col("doc_id").alias("wanted"))
        out = met if out is None else out.unionByName(met)
    return out


GOLD = "gold AS (SELECT item_id, doc_id AS wanted FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = """SELECT item_id,
        round(coalesce(hit5 / n_wanted, 0), 6) AS recall_5, round(coalesce(hit10 / n_wanted, 0), 6) AS recall_10, round(coalesce(right_n / n_found, 0), 6) AS precision_10, round(coalesce(1.0 / first_n, 0), 6) AS mrr
    FROM (SELECT item_id, count(DISTINCT wanted) AS n_wanted FROM gold GROUP BY item_id) FULL JOIN (SELECT item_id, count(*) AS n_found FROM {0} WHERE rank <= 10 GROUP BY item_id) USING (item_id)
    LEFT JOIN (SELECT item_id, count(DISTINCT wanted) FILTER (rank <= 5) AS hit5, count(DISTINCT wanted) AS hit10, count(DISTINCT rank) AS right_n, min(rank) AS first_n
        FROM {0} JOIN gold USING (item_id) WHERE rank <= 10 AND doc_id = wanted GROUP BY item_id) USING (item_id)"""


@query(f"WITH {BM25}, {GOLD} {METRICS.format('kw')}")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.retrieval(kept(keyword_leg(spark, sf_dir), "top"), kept(gold(spark, sf_dir), "gold"), "item_id", "doc_id", "wanted")


@query(f"WITH {BM25}, {GOLD}, m AS ({METRICS.format('kw')}) SELECT 'keyword' AS config, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr, count(recall_5) AS n_recall_5, count(mrr) AS n_mrr FROM m")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(retrieval_metrics(spark, sf_dir).withColumn("config", F.lit("keyword")), ["config"], ["recall_5", "mrr"])


@query(f"""WITH {BM25}, {SEMANTIC}, {FUSED}, sweep AS (
        SELECT *, row_number() OVER (PARTITION BY alpha, item_id ORDER BY score DESC, sem_rank IS NULL, coalesce(sem_rank, kw_rank), doc_id) AS place FROM (
            SELECT alpha, item_id, doc_id, sem_rank, kw_rank, round(coalesce(alpha / (20 + sem_rank), 0) + coalesce((1 - alpha) / (20 + kw_rank), 0), 8) AS score
            FROM pooled CROSS JOIN (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) a(alpha)
        )
    ) SELECT alpha, item_id, doc_id, place AS rank, score AS rrf_score FROM sweep WHERE place <= 10""")
def rrf_alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.swept(semantic_leg(spark, sf_dir), keyword_leg(spark, sf_dir), "item_id", "doc_id", ALPHAS)
    return out.select("alpha", "item_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), "rrf_score")

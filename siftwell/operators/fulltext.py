"""Keyword search: postings, statistics and BM25 ranks for a whole table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import stem
from .kept import kept

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has limit rows at most; its size is counted first."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def postings(docs: DataFrame, key: str, text: str, terms=T.tokens) -> DataFrame:
    """(term, key, tf): counted per document before any shuffle of terms."""
    return docs.select(key, F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, text: str, terms=T.tokens) -> DataFrame:
    return docs.select(key, F.size(terms(F.col(text))).cast("bigint").alias("len"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, times): query words, how often each is repeated."""
    return queries.select(key, F.explode(T.query_terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, terms=T.tokens, wanted=query_terms) -> DataFrame:
    """(query_key, key, rank_score): lower is better, repeats of a query word count again.

    Only postings of query words are kept, before they are counted; the query
    words are broadcast if they are few. A document's length travels with its
    postings, and one row of totals is broadcast.
    """
    asked = wanted(queries, query_key, query_text)
    cut = docs.select(key, terms(F.col(text)).alias("words")).select(key, F.size("words").cast("bigint").alias("len"), F.explode("words").alias("term"))
    hits = cut.join(bounded(asked.select("term").distinct()), "term", "left_semi").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    return _ranked(hits, _totals(lengths(docs, key, text, terms)), asked, key, query_key)


def _totals(size: DataFrame) -> DataFrame:
    return size.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))


def _ranked(hits: DataFrame, totals: DataFrame, asked: DataFrame, key: str, query_key: str) -> DataFrame:
    """hits: key, len, term, tf; asked: query_key, term, times."""
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weights = df.crossJoin(F.broadcast(totals)).select("term", idf.alias("idf"), "mean")
    scored = hits.join(weights, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = scored.select(key, "term", part.alias("part"))
    return scored.join(asked, "term").groupBy(query_key, key).agg((-F.sum(F.col("part") * F.col("times"))).alias("rank_score"))


def bm25_stemmed(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str) -> DataFrame:
    """(query_key, key, rank_score): as bm25, over words without accents and endings; lower is better.

    Only distinct words go through the stemmer. A query word of several parts,
    such as snake_case, is a phrase: its stems must stand side by side, and it
    counts as one term of its own. Query words without letters or digits match
    nothing.
    """
    asked = queries.select(query_key, F.explode(T.query_terms(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("times"))
    parts = asked.select("term").distinct().select("term", F.posexplode(T.tokens(F.col("term"))).alias("nth", "word"))
    parts = stem.stems(parts, "word")
    spelt = kept(parts.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "stem"))), lambda p: p["stem"]), " ").alias("phrase")), "phrases")
    asked = asked.join(spelt, "term").groupBy(query_key, F.col("phrase").alias("term")).agg(F.sum("times").alias("times"))
    wanted = spelt.select("phrase").distinct().select(F.col("phrase").alias("term"), F.posexplode(F.split("phrase", " ")).alias("nth", "stem")).withColumn("parts", F.size(F.split("term", " ")))
    cut = docs.select(key, T.tokens(F.col(text)).alias("words")).select(key, F.size("words").cast("bigint").alias("len"), F.posexplode("words").alias("pos", "word"))
    vocabulary = kept(stem.stems(cut.select("word").distinct(), "word").join(bounded(wanted.select("stem").distinct()), "stem", "left_semi"), "vocabulary")
    met = cut.join(bounded(vocabulary), "word").join(bounded(wanted), "stem")
    single = met.where("parts = 1").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    started = met.where("parts > 1").groupBy(key, "len", "term", "parts", (F.col("pos") - F.col("nth")).alias("start")).agg(F.count("*").alias("there"))
    phrases = started.where("there = parts").groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    return _ranked(single.unionByName(phrases), _totals(lengths(docs, key, text)), asked, key, query_key)


def top_k(scored: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group, with rank; Spark limits each group before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def phrase_hits(docs: DataFrame, key: str, text: str, phrase: list[str]) -> DataFrame:
    """(key, hits): how often the words of a phrase stand side by side."""

    def hits(words):
        def here(i):
            out = F.get(words, i) == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                out = out & (F.get(words, i + k) == w)
            return out

        return F.size(F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), here))

    rows = docs.select(key, T.tokens(F.col(text)).alias("words")).where(F.size("words") >= len(phrase))
    # a lambda's variable, so that the words are cut once
    return rows.select(key, F.transform(F.array("words"), hits).getItem(0).cast("bigint").alias("hits")).where("hits > 0")

"""Fusion of ranked lists, late hydration and search modes, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS
from .fulltext import top_k

ALPHA, RRF_K, CANDIDATES, KEYWORD_CANDIDATES, KEEP = DEFAULTS.alpha, DEFAULTS.rrf_k, DEFAULTS.semantic_candidates, DEFAULTS.keyword_candidates, DEFAULTS.top_k


def fused(semantic: DataFrame, keyword: DataFrame, query: str, key: str, alpha: float | Column = ALPHA, k: int = RRF_K, keep: int | None = KEEP, decimals: int = 8) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lists with columns query, key, rank, score.

    A full outer join on (query, key): a missing side adds nothing. Ties keep
    the semantic list first, by its rank, then the keyword list by its own.
    """
    weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    left = semantic.select(query, key, F.col("rank").alias("sem_rank"), F.col("score").alias("semantic_score"))
    right = keyword.select(query, key, F.col("rank").alias("kw_rank"), F.col("score").alias("keyword_score"))
    both = left.join(right, [query, key], "full_outer")
    score = F.coalesce(weight / (F.lit(k) + F.col("sem_rank")), F.lit(0.0)) + F.coalesce((F.lit(1.0) - weight) / (F.lit(k) + F.col("kw_rank")), F.lit(0.0))
    both = both.withColumn("rrf_score", F.round(score, decimals))
    if keep is None:
        return both
    return top_k(both, query, tie_order(key), keep)


def tie_order(key: str) -> list[Column]:
    return [F.desc("rrf_score"), F.col("sem_rank").isNull().asc(), F.coalesce("sem_rank", "kw_rank").asc(), F.asc(key)]


def plain_fused(lists: list[DataFrame], query: str, key: str, k: int = 60, keep: int = KEEP) -> DataFrame:
    """Unweighted fusion of any number of lists: the sum of 1 / (k + rank)."""
    parts = [x.select(query, key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for x in lists]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    scored = union.groupBy(query, key).agg(F.round(F.sum("part"), 8).alias("rrf_score"))
    return top_k(scored, query, [F.desc("rrf_score"), F.asc(key)], keep)


def swept(semantic: DataFrame, keyword: DataFrame, query: str, key: str, alphas: tuple[float, ...], k: int = RRF_K, keep: int = KEEP) -> DataFrame:
    """Fusion under several weights in one plan: the lists are joined once, then each row is scored for each weight."""
    both = fused(semantic, keyword, query, key, keep=None).drop("rrf_score")
    each = both.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    score = F.coalesce(F.col("alpha") / (F.lit(k) + F.col("sem_rank")), F.lit(0.0)) + F.coalesce((1 - F.col("alpha")) / (F.lit(k) + F.col("kw_rank")), F.lit(0.0))
    each = each.withColumn("rrf_score", F.round(score, 8)).withColumn("config", F.struct("alpha", query))
    return top_k(each, "config", tie_order(key), keep).drop("config")


def hydrated(results: DataFrame, rows: DataFrame, key: str, kinds: list | None = None, kind: str = "page_type") -> DataFrame:
    """Results with the rows' columns, joined after the cut to the first k; kinds filters only then, so fewer may be left.

    Rows not found are dropped; a missing kind counts as other.
    """
    out = results.join(rows, key)
    if kinds:
        out = out.where(F.coalesce(F.col(kind).cast("string"), F.lit("other")).isin(*[str(x) for x in kinds]))
    return out


def search(mode: str, semantic: DataFrame, keyword: DataFrame, query: str, key: str, alpha: float = ALPHA, k: int = RRF_K, keep: int = KEEP) -> DataFrame:
    """semantic or keyword alone, else both fused; any other mode is hybrid."""
    if mode == "semantic":
        return semantic.where(F.col("rank") <= keep)
    if mode == "keyword":
        return keyword.where(F.col("rank") <= keep)
    return fused(semantic, keyword, query, key, alpha, k, keep)

"""Retrieval and answer metrics, profiles and rollups."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship

BRACKETS = (0, 10, 50, 100, 256, 512, 1024)


def retrieval(results: DataFrame, gold: DataFrame, query: str, found: str, wanted: str, match: Column | None = None) -> DataFrame:
    """(query, recall_5, recall_10, precision_10, mrr) of every query in results or gold.

    results: query, rank, found (first 10 count); gold: query, wanted. match says
    when a found value fits a wanted one, default: equal. A query without wanted
    values has recall 0, one without results precision 0.
    """
    top = results.where("rank <= 10").select(query, "rank", found)
    want = gold.select(query, wanted).distinct()
    fits = top.join(want, query).where(match if match is not None else F.col(found) == F.col(wanted))
    per = fits.groupBy(query).agg(
        F.countDistinct(F.when(F.col("rank") <= 5, F.col(wanted))).alias("hit5"), F.countDistinct(wanted).alias("hit10"), F.countDistinct("rank").alias("right"), F.min("rank").alias("first")
    )
    sizes = want.groupBy(query).agg(F.count("*").alias("n_wanted"))
    given = top.groupBy(query).agg(F.count("*").alias("n_found"))
    joined = sizes.join(given, query, "full_outer").join(per, query, "left")

    def share(a: str, b: str) -> Column:
        return F.round(F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)), 6)

    return joined.select(
        query, share("hit5", "n_wanted").alias("recall_5"), share("hit10", "n_wanted").alias("recall_10"), share("right", "n_found").alias("precision_10"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr")
    )


def image_recall(found: Column, wanted: Column) -> Column:
    """Share of wanted file names that are part of a found URL; all entries count; 0 without any."""
    hits = F.size(F.filter(wanted, lambda w: F.exists(found, lambda f: (w != "") & F.contains(f, w))))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(0.0)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the two sets of lower-cased words; 0 if either is empty."""
    x, y = F.array_distinct(T.space_tokens(a)), F.array_distinct(T.space_tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.when(both > 0, 2.0 * both / (F.size(x) + F.size(y))), F.lit(0.0))


def citation_faithfulness(answer: Column, titles: Column, source: Column) -> Column:
    """Of the first five sources, those whose title has the source page in it are right: 1 if the answer cites one, 0 if none, null if there is no right one."""
    right = F.filter(F.transform(F.slice(titles, 1, 5), lambda t, i: F.when(F.contains(F.lower(t), F.lower(source)), i + 1)), lambda i: i.isNotNull())
    cited = T.citation_numbers(answer)
    return F.when(F.size(right) > 0, F.arrays_overlap(right, cited).cast("double"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a whole row of the table a step: its bits are those of one integer.

    A zero at bit i says that the row's value grows there; each word of the longer
    list changes the row by one addition, so the cost is that of the words of one
    list times the machine words of the other.
    """
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        if same := row & places.get(word, 0):
            row = (row + same | row - same) & full
    return len(b) - row.bit_count()


def rouge_l(rows: DataFrame, key: list[str], answer: str, reference: str) -> DataFrame:
    """(key..., rouge_l): F1 of the longest common subsequence of lower-cased words; 0 if either is empty."""
    ship(rows.sparkSession)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["answer"], b["reference"]):
                x, y = (x or "").lower().split(), (y or "").lower().split()
                n = lcs_length(x, y) if x and y else 0
                out.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
            yield b[key].assign(rouge_l=out)

    source = rows.select(*key, F.col(answer).alias("answer"), F.col(reference).alias("reference"))
    types = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in key)
    return source.mapInPandas(score, f"{types}, rouge_l double")


def summary(metrics: DataFrame, config: list[str], columns: list[str], sums: list[str] | None = None) -> DataFrame:
    """Means (nulls left out) and numbers of values for each configuration, and sums of counts such as tokens (0 for none)."""
    totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums or []]
    return metrics.groupBy(*config).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in columns], *[F.count(c).alias(f"n_{c}") for c in columns], *totals)


def latency(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]], questions: int) -> DataFrame:
    """(config, questions, seconds, seconds_a_question): wall-clock time of each run for all its questions, results thrown away."""
    rows = []
    for name, run in runs.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append((name, questions, took, took / max(1, questions)))
    return spark.createDataFrame(rows, "config string, questions bigint, seconds double, seconds_a_question double")


def histogram(rows: DataFrame, value: str, brackets: tuple[int, ...] = BRACKETS) -> DataFrame:
    """(low, n, pct): numbers and percents of values from each bracket's lower bound to the next."""
    low = F.lit(None).cast("int")
    for b in brackets:
        low = F.when(F.col(value) >= b, F.lit(b)).otherwise(low)
    counted = rows.select(low.alias("low")).groupBy("low").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("low", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


def largest(rows: DataFrame, value: str, key: str, over: int, k: int = 10) -> DataFrame:
    """The k largest values over a bound: a top-k report."""
    return rows.where(F.col(value) > over).orderBy(F.desc(value), key).limit(k)


def small_groups(rows: DataFrame, group: str, kind: str, value: str, below: int, least: int) -> DataFrame:
    """Groups with at least so many rows below a bound, and their numbers by kind as k=n, sorted."""
    kinds = rows.where(F.col(value) < below).groupBy(group, kind).agg(F.count("*").alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.coalesce(F.col(kind).cast("string"), F.lit("?")), F.lit("="), F.col("n").cast("string")))), ",")
    return kinds.groupBy(group).agg(F.sum("n").alias("n_small"), listed.alias("kinds")).where(F.col("n_small") >= least)


def storage(rows: DataFrame, kind: str, text: str, dimension: int = 768) -> DataFrame:
    """Rows, text and vector bytes of each kind, and of all (kind null)."""
    return rows.rollup(kind).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("text_bytes"), (F.count("*") * dimension * 4).alias("vector_bytes"))

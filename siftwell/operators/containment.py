"""Which texts of one table stand inside texts of another, by runs of a few characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a run; shorter texts are looked for whole.
RUN = 4


def runs(text: Column, width: Column | int) -> Column:
    """All runs of so many characters of a text, each once; the empty one where width is 0."""
    n = F.length(text)
    width = F.lit(width) if isinstance(width, int) else width
    at = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(width == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.transform(at, lambda i: F.substr(text, i, width))))


def contained(inner: DataFrame, outer: DataFrame, run: int = RUN) -> DataFrame:
    """(inner, outer): pairs of distinct texts of which the first stands in the second.

    inner has one column inner, outer one column outer. Each inner text is looked
    for by the one of its runs that the fewest outer texts have, and what that
    finds is compared whole. An outer text gives about as many rows as it has
    characters, for each width that inner texts need. Nulls stand in nothing; the
    empty text stands in all.
    """
    inner, outer = inner.where("inner IS NOT NULL").distinct(), outer.where("outer IS NOT NULL").distinct()
    width = F.least(F.lit(run), F.length("inner"))
    widths = [r[0] for r in inner.select(width).distinct().collect()]  # run + 1 at most
    if not widths:
        return inner.join(outer, F.lit(False)).select("inner", "outer")
    grams = outer.select("outer", F.explode(F.flatten(F.array(*[runs(F.col("outer"), w) for w in widths]))).alias("gram"))
    asked = inner.select("inner", F.explode(runs(F.col("inner"), width)).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count("*").alias("n"))
    seeds = asked.join(seen, "gram").groupBy("inner").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("found"), F.first(F.size(runs(F.col("inner"), width))).alias("all"))
    seeds = seeds.where(F.col("found") == F.col("all")).select("inner", "gram")  # a run that nowhere stands rules the text out
    return grams.join(seeds, "gram").where(F.contains("outer", F.col("inner"))).select("inner", "outer")

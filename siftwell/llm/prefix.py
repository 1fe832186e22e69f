"""Prefix sums over all rows of a table in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """df with a column for each of sums: its total over all rows that come before in the order.

    Rows are dealt to ranges of the order, so that a hot value of the first
    column is cut by the next ones, and written; a range's rows are summed in its
    task, the ranges' totals (a row a partition) among themselves. df is computed
    twice, as ranges are chosen by a sample, so it should be a written table.
    Rows that are equal in the order come in any order.
    """
    part = unused(df, "part")
    values = {c: (unused(df, f"{c}_own"), unused(df, f"{c}_before")) for c in sums}
    dealt = df.withColumns({values[c][0]: v for c, v in sums.items()}).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    dealt = materialize(dealt, name)
    totals = dealt.groupBy(part).agg(*[F.sum(own).alias(own) for own, _ in values.values()])
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(part, *[F.coalesce(F.sum(own).over(before), F.lit(0)).alias(last) for own, last in values.values()])
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(totals), part)  # as many rows as there are partitions
    joined = joined.withColumns({c: (F.col(last) + F.coalesce(F.sum(own).over(within), F.lit(0))).cast("bigint") for c, (own, last) in values.items()})
    return joined.drop(part, *[x for both in values.values() for x in both])

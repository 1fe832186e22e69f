"""Relational queries that Spark offers beside the corpus operators: rollups, windows, sets, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed by customer before they meet the dimensions."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    rows = per.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum("t"), 2).alias("total"))


@query("""SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders""")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(order), 2).alias("running"))


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000""")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an order of over 400,000."""
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query("""SELECT event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND (p.ts, p.event_id) < (e.ts, e.event_id)
      AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'view' AND (q.ts, q.event_id) > (p.ts, p.event_id) AND (q.ts, q.event_id) < (e.ts, e.event_id))) AS last_view
    FROM events e WHERE event_type = 'purchase'""")
def last_view_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: each purchase with the user's last view before it, by one window over both."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "events").withColumn("last_view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order))
    return rows.where("event_type = 'purchase'").select("event_id", "last_view")


@query("""SELECT p_brand, sum(n)::BIGINT AS n, round(sum(q), 2) AS qty FROM part JOIN (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey GROUP BY p_brand""")
def brand_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return per.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("qty"))

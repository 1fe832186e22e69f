"""Link graphs: edges, degrees, PageRank, page scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .fulltext import bounded
from .kept import bucketed, dropped, kept

MAX_LINKS = 100
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 50
#: Edges out of a node that stand in one bucket; more are dealt to several.
EDGES_A_PART = 100_000


def hrefs(page: Column) -> Column:
    """The targets of a page's links, in order, repeats too."""
    return F.regexp_extract_all(page, F.lit(r"(?i)<a\s[^>]*href=\"([^\"]*)\""), F.lit(1))


def links(pages: DataFrame, key: str, page: str, prefix: str = "/w/", most: int = MAX_LINKS) -> DataFrame:
    """(key, ordinal, target): each page's first distinct link targets."""
    titles = F.filter(F.transform(hrefs(F.col(page)), lambda h: U.href_to_title(h, prefix)), lambda t: t.isNotNull())
    return pages.select(key, F.posexplode(F.slice(F.array_distinct(titles), 1, most)).alias("ordinal", "target"))


def graph(edges: DataFrame, known: DataFrame, title: str) -> DataFrame:
    """Edges whose target is a known page."""
    return edges.join(bounded(known.select(F.col(title).alias("_t")).distinct()), F.col("target") == F.col("_t"), "left_semi")


def adjacency(edges: DataFrame, source: str) -> DataFrame:
    return edges.groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "target"))), lambda s: s["target"]).alias("targets"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.count("*").alias("n"))


def stats(edges: DataFrame, source: str) -> DataFrame:
    per = edges.groupBy(source).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("pages"), F.sum("n").alias("links"), F.round(F.avg("n"), 6).alias("mean_links"))


def adjacent(edges: DataFrame, source: str = "src", target: str = "dst", edges_a_part: int = EDGES_A_PART) -> tuple[DataFrame, DataFrame]:
    """Tables in buckets: (s, part, d) by node and part, and the nodes (node, out) by node.

    A node's edges out are dealt to parts of about edges_a_part, so that one with
    very many is in many buckets; repeated edges are kept. out is null without edges.
    """
    e = kept(edges.select(F.col(source).alias("s"), F.col(target).alias("d")), "edges")
    degree = kept(e.groupBy("s").agg(F.count("*").alias("out")), "degrees")
    buckets = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = e.select(F.col("s").alias("node")).union(e.select("d")).distinct().join(degree, F.col("node") == F.col("s"), "left").select("node", "out")
    dealt = e.join(degree, "s").select("s", F.pmod(F.xxhash64("d"), _parts(edges_a_part)).alias("part"), "d")
    return bucketed(dealt, ["s", "part"], buckets, "adjacency"), bucketed(nodes, ["node"], buckets, "nodes")


def _parts(edges_a_part: int) -> Column:
    return F.ceil(F.col("out") / edges_a_part)


def rank_round(e: DataFrame, now: DataFrame, n: int, damping: float = DAMPING, edges_a_part: int = EDGES_A_PART) -> DataFrame:
    """(node, out, old, rank) after one round: only the nodes' shares move to the edges, and their sums to the targets; edges and ranks stay in their buckets."""
    loose = now.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
    shares = now.where("out IS NOT NULL").select("node", F.explode(F.sequence(F.lit(0).cast("bigint"), _parts(edges_a_part) - 1)).alias("of"), (F.col("rank") / F.col("out")).alias("share"))
    given = e.join(shares, (F.col("s") == F.col("node")) & (F.col("part") == F.col("of"))).groupBy("d").agg(F.sum("share").alias("in"))
    base = F.lit((1 - damping) / n) + F.lit(damping / n) * F.col("loose")
    after = now.join(given, F.col("node") == F.col("d"), "left").crossJoin(F.broadcast(loose))  # one row
    return after.select("node", "out", F.col("rank").alias("old"), (base + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))


def pagerank(edges: DataFrame, source: str = "src", target: str = "dst", damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, edges_a_part: int = EDGES_A_PART) -> DataFrame:
    """(node, rank), as long as the sum of changes is over the tolerance, tested each round, rounds at most.

    Repeated edges are single steps, each counted. Nodes without edges out give
    their rank to all. Shares are summed before the shuffle, so a page with very
    many links in is no single task, nor is one with very many links out. Each
    round is written in the buckets of the one before, which then goes.
    """
    e, nodes = adjacent(edges, source, target, edges_a_part)
    buckets = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    now = nodes.select("node", "out", F.lit(1.0 / n if n else 0.0).alias("rank"))
    last = nodes
    for _ in range(rounds if n else 0):
        after = bucketed(rank_round(e, now, n, damping, edges_a_part), ["node"], buckets, "ranks")
        dropped(last)
        last, now = after, after.select("node", "out", "rank")
        if tolerance is not None and after.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    dropped(e)
    out = e.sparkSession.read.schema(last.schema).parquet(last._path)
    dropped(last, files=False)
    return out.select("node", F.col("rank") if "rank" in out.columns else F.lit(1.0 / n if n else 0.0).alias("rank"))


def page_score(rank: Column, words: Column, infobox: Column, images: Column, title: Column) -> Column:
    """Log of the rank times log of the words, more with an infobox and images, less for meta pages."""
    size = F.log10(F.greatest(words, F.lit(1)).cast("double"))
    rich = 1 + 0.5 * infobox.cast("int") + 0.01 * F.least(images, F.lit(50))
    return F.log10(F.coalesce(rank, F.lit(0.0)) * 1e6 + 1) * size * rich * F.when(T.is_meta(title), 0.3).otherwise(1.0)


def score_stages(pages: DataFrame, key: str, top: int = 15) -> DataFrame:
    """(stage, place, key, score): the top pages by rank, rank times words, logs, and the final score."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.round(F.col(s), 6).alias("score")) for s in ("rank_only", "rank_words", "log_log", "final")])
    each = pages.select(key, F.explode(stages).alias("x")).select(key, "x.stage", "x.score")
    place = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("score"), key))
    return each.withColumn("place", place).where(F.col("place") <= top)

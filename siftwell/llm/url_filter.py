"""Operator 8, URL filters by a sort-merge range join.

A host's labels reversed, each with a mark after it, make a key under which a
rule's host and all its subdomains are one interval. The URLs are dealt out and
sorted by that key (then by path and id, so that a host with very many URLs goes
to many tasks), and each task sweeps its range beside the sorted rules, keeping
a stack of the rules whose intervals it is in, innermost on top.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

MARK = "\x01"
#: Rules up to which each task gets them all; beyond, hosts are joined with them.
SWEEP_RULES = 200_000
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host, up to ?, # or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Reversed labels, each with MARK after it; a subdomain's key starts with its domain's."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK)))


class Sweep:
    """The rules in key order, with a stack of those that hold at the current key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        frames: dict[str, dict[str, tuple[str, str]]] = {}
        for key, path, name, verdict in rules:
            frames.setdefault(key, {}).setdefault(path, (name, verdict))
        self.frames = sorted(frames.items())
        self.lengths = [sorted({len(p) for p in f}, reverse=True) for _, f in self.frames]
        self.next, self.stack = 0, []

    def move(self, key: str) -> None:
        """To a key not below the last one."""
        while self.stack and not key.startswith(self.frames[self.stack[-1]][0]):
            self.stack.pop()
        while self.next < len(self.frames) and self.frames[self.next][0] <= key:
            if key.startswith(self.frames[self.next][0]):
                self.stack.append(self.next)
            self.next += 1

    def judge(self, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the innermost host with a fitting path, the longest there."""
        for k in reversed(self.stack):
            frame = self.frames[k][1]
            for n in self.lengths[k]:
                if n <= len(path) and (found := frame.get(path[:n])):
                    return found
        return None, None


def judged(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT, sweep_rules: int = SWEEP_RULES) -> DataFrame:
    """(key, host, path, rule, verdict) of every row; rules has host, path, verdict.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's. The longest wins: the innermost host, then the longest path. rule is
    the winner's host and path together, else null with the default verdict. Of
    rules with the same host and path the verdict first by name holds; rules with
    a null are left out.

    Null URLs and those without :// have empty host and path and fit no rule.
    Repeated rows and null keys are kept; an empty table gives an empty result;
    other columns are not read. The rules go to the tasks whole only if they are
    sweep_rules at most; beyond that distinct hosts are joined with them by their
    chains of domains.
    """
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.select("key", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    low = F.translate(F.col("host"), string.ascii_uppercase, string.ascii_lowercase)
    ordered = rules.select(host_key(low).alias("at"), F.col("path").alias("of"), F.concat(low, F.col("path")).alias("rule"), "verdict").dropna()
    ordered = ordered.where("at <> ''").groupBy("at", "of", "rule").agg(F.min("verdict").alias("verdict"))
    few = ordered.limit(sweep_rules + 1).collect()
    out = _swept(rows, sorted(map(tuple, few)), default) if len(few) <= sweep_rules else _joined(rows, ordered, default)
    return out.select(F.col("key").alias(key), "host", "path", "rule", "verdict")


def _swept(rows: DataFrame, rules: list[tuple], default: str) -> DataFrame:
    ship(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.withColumn("at", host_key(F.col("host"))).repartitionByRange("at", "path", "key").sortWithinPartitions("at")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active, last = Sweep(rules), ""
        for batch in batches:
            found = []
            for at, path in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist()):
                if at != last:
                    active.move(at)
                    last = at
                found.append(active.judge(path))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())],
                names=["key", "host", "path", "rule", "verdict"],
            )

    return placed.mapInArrow(sweep, f"key {kind}, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rules too many to send to each task: each distinct (host, path) with the rules of its domains."""
    distinct = rows.select("host", "path").distinct()
    labels = F.reverse(F.split("host", r"\."))
    chain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), MARK), F.lit(MARK)))
    fits = distinct.select("host", "path", F.explode(chain).alias("at")).join(rules, "at").where(F.col("path").startswith(F.col("of")))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("at").alias("a"), F.length("of").alias("b"))).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select("key", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")

"""Operator 6, SimHash near-duplicates over a byte-position inverted index.

Fingerprints within 2 bits agree in at least 6 of their 8 bytes. The index has
an entry for each of six sets of four byte positions; the sets are chosen so
that whichever two positions differ, one set avoids both (the complements are
a covering of all pairs by quadruples). So each linked pair meets in an entry;
there the bytes that the pair shares are tallied, pairs that reach the minimum
of 6 are kept and the differing bits are counted. An entry with more than
SMALL fingerprints is not paired out: every fingerprint there posts itself and
its one-bit neighbours, and those that post the same value are within 2 bits of
one another, so each links to the smallest. That is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SMALL = 24
EDGES_A_TASK = 200_000
#: Byte positions of each index entry: for any two positions, one set has neither.
POSITIONS = ((0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7))
assert all(any(not {i, j} & set(p) for p in POSITIONS) for i, j in combinations(range(8), 2))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of so many words, in order; a shorter text is one run, no words are none."""
    import xxhash

    words = text.translate(_LOWER).split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)] if words else [], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))


def print_of(hashes: np.ndarray) -> int:
    """SimHash of shingles' hashes; bit 1 where over half of them have it; none: 0."""
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 200_000):
        counts += np.unpackbits(hashes[k : k + 200_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one text."""
    return print_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint): the fingerprint as a signed 64-bit number; null texts count as empty."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values = np.fromiter((fingerprint(x.as_py() or b"") for x in column), dtype=np.uint64, count=len(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(hashed, f"key {kind}, fp bigint").withColumnRenamed("key", key)


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _shared_bytes(x: Column) -> Column:
    """Of an XOR: how many of the eight bytes are zero."""
    return sum((F.when(x.bitwiseAND(F.lit(_mask((p,)))) == 0, 1).otherwise(0) for p in range(8)), F.lit(0))


def links(prints: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a < b, enough to join all fp within MAX_BITS; prints: one column fp, distinct.

    Between fingerprints of small entries these are all links; in large entries,
    links to the smallest of each neighbourhood.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("entry"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for k, p in enumerate(POSITIONS)]))
    posted = prints.select("fp", each.alias("e")).select("fp", "e.entry", "e.bytes")
    sizes = posted.groupBy("entry", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    shared = posted.join(sizes, ["entry", "bytes"])
    lists = shared.where(F.col("size") <= SMALL).groupBy("entry", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("l"))
    small = lists.select("l", F.explode("l").alias("a")).select("a", F.explode("l").alias("b")).where("a < b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    small = small.where(_shared_bytes(differ) >= 8 - MAX_BITS).where(F.bit_count(differ) <= MAX_BITS)
    flips = [F.array(F.lit(0).cast("bigint"), *[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("bigint") for b in range(64) if b // 8 not in p]) for p in POSITIONS]
    own = F.element_at(F.array(*flips), F.col("entry") + 1)
    near = shared.where(F.col("size") > SMALL).select("fp", F.explode(own).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    least = near.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    large = near.join(least, "value").where("a < fp").select("a", F.col("fp").alias("b"))
    return small.unionByName(large).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root): for each node of edges (a, b) the smallest node reachable.

    Large-star and small-star rounds, each a join and a grouped minimum; the
    edges are written to the shared folder after each round, and the rounds end
    when they no longer change. No list of neighbours is ever built. Few edges
    run in few tasks, EDGES_A_TASK in each.
    """
    def known(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    seen = known(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        tasks = 1 + seen[0] // EDGES_A_TASK
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        wide = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        lowest = wide.groupBy("a").agg(F.min("b").alias("m"))
        joined = wide.join(lowest, "a")
        close = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks).unionByName(lowest.select("a", F.col("m").alias("b")).coalesce(tasks))
        last, now = now, materialize(close.distinct().coalesce(tasks), name)
        then, seen = seen, known(now)
        discard(last)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Equal fingerprints are grouped before the search and stand there as their
    smallest key, so groups of copies cost one entry. Null and empty texts have
    fingerprint zero and link like any other. Repeated rows are all returned. A
    null key is never a component's id: rows of a fingerprint with null keys
    alone get the smallest key they link to, or null. An empty table gives an
    empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, key, text), "simhash-prints")
    groups = materialize(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-groups")
    found = components(links(groups.select("fp")), "simhash-links")
    joined = groups.join(found, groups.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(roots, "root").select(F.col("fp").alias("print"), "component_id")
    out = rows.join(named, F.col("fp") == F.col("print"))
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

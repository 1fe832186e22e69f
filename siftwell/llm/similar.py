"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash first, then a prefix filter for the rest.

A text is the set of its hashed five-word shingles. Operator 6 links texts whose
fingerprints differ in few bits, by its byte-position index with count filter;
such links are compared exactly. But fingerprints of texts of similarity 4/5 may
differ in ten bits and more, so the rest has an exact way: two sets of that similarity share a shingle among the
first fifth of each, whatever the order of shingles, as long as it is one for all
(prefix filter). The order puts shingles that a sample shows to be frequent last;
that saves work and loses nothing. Texts of different groups that share a shingle
there are compared, if lengths and places allow the similarity.

A comparison starts with sketches: shingles thrown into as many bits as there
are shingles, each bit the parity of its shingles. Sets differ in at least as
many shingles as their sketches differ in bits, so a pair whose sketches are too
far apart is not similar; the texts of the others are compared whole.

A shingle of many texts is not paired out at first. All its texts are compared
with one of them, the pivot: that with the fewest rarer shingles before it, the
likeliest original of the others. What the links found so far join needs no
further comparison. Shingles whose texts are not yet one group go on with a next
pivot; after ROUNDS, texts of different groups are paired, where the places allow
it. Those whose own shingles stand before the shared one are out by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, materialize
from .simhash import components, print_of, shingle_hashes
from .simhash import links as near_prints

SHINGLE = 5
#: Least similarity, as a fraction: compared in whole numbers.
NUM, DEN = 4, 5
SMALL = 100
ROUNDS = 2
#: One text of SAMPLE tells the frequent shingles: those it has OFTEN times, MOST of them at most.
SAMPLE, OFTEN, MOST = 16, 3, 200_000
_SLOTS = 1 << 24
SLICE_ROWS = 512
#: Rows of two numbers up to which the texts to compare are broadcast.
BROADCAST_ROWS = 200_000


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes; a shorter text is one shingle, no words are none."""
    return np.unique(shingle_hashes(text, shingle))


def _slots(often: np.ndarray) -> np.ndarray:
    """A bit a slot, eight to a byte: each worker holds one."""
    found = np.zeros(_SLOTS // 8, dtype=np.uint8)
    slot = (often & np.uint64(_SLOTS - 1)).astype(np.int64)
    np.bitwise_or.at(found, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
    return found


def _among(slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
    return (slots[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _sampled(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that stand in several texts of a sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), shingle).view(np.int64))], names=["hash"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("text"))
    counted = some.mapInArrow(each, "hash bigint").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    often = counted.orderBy(F.desc("n"), "hash").limit(MOST).select("hash").toArrow().column(0)
    return np.asarray(often.to_numpy(), dtype=np.int64).view(np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """Parities of a set's hashes in as many bits as a power of two not below its size, 64 at least; packed."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(one: bytes, other: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded: the sets differ in so many shingles at least."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def _marks(docs: DataFrame, shingle: int, often: np.ndarray) -> DataFrame:
    """(who, copy, id, n, fp, sketch, first): the set's digest, its size, fingerprint and sketch, and its first shingles in the order."""
    import xxhash

    packed = often.tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = _slots(np.frombuffer(packed, dtype=np.uint64))
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                ids, sizes, prints, sketches, firsts = [], [], [], [], []
                for text in batch.column(2):
                    hashes = shingle_hashes(text.as_py(), shingle)
                    s = np.unique(hashes)
                    behind = _among(late, s)
                    k = len(s) - -(-NUM * len(s) // DEN) + 1 if len(s) else 0
                    ids.append(xxhash.xxh64_intdigest(s.tobytes(), 1))
                    sizes.append(len(s))
                    prints.append(print_of(hashes))
                    sketches.append(sketch(s))
                    firsts.append(np.concatenate([s[~behind][:k], s[behind][:k]])[:k].view(np.int64))
                made = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (ids, prints)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), made[0], pa.array(sizes, pa.int32()), made[1], pa.array(sketches, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))],
                    names=["who", "copy", "id", "n", "fp", "sketch", "first"],
                )

    rows = docs.select("who", "copy", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(each, f"who {rows.schema['who'].dataType.simpleString()}, copy binary, id bigint, n int, fp bigint, sketch binary, first array<bigint>")


def _few(wanted: DataFrame) -> DataFrame:
    """For a broadcast, if its rows of two numbers are few."""
    return F.broadcast(wanted) if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else wanted


def _may(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m shingles can be similar whose first shared one is at these places."""
    return (F.lit(1) + F.least(n - 1 - at, m - 1 - to)) * (NUM + DEN) >= (n + m) * NUM


def _paired(shared: DataFrame) -> DataFrame:
    """(a, b) of shingles with few texts."""
    lists = shared.groupBy("hash").agg(F.collect_list(F.struct("id", "n", "at")).alias("l"))
    one = lists.select("l", F.explode("l").alias("x"))
    others = F.filter("l", lambda y: (y["id"] > F.col("x.id")) & _may(F.col("x.n"), F.col("x.at"), y["n"], y["at"]))
    return one.select(F.col("x.id").alias("a"), F.explode(F.transform(others, lambda y: y["id"])).alias("b")).distinct()


def _possible(pairs: DataFrame, once: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            apart = np.array([least_difference(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())], dtype=np.int64)
            # of n shingles in both together, similar sets differ in n (1 - s) / (1 + s) at most
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(apart * (NUM + DEN) <= sizes * (DEN - NUM)))

    left, right = (once.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b").mapInArrow(each, "a bigint, b bigint")


def _linked(pairs: DataFrame, docs: DataFrame, once: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of similar sets, written; texts travel, not sets: they are shorter and can be compressed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            similar = []
            for k in range(batch.num_rows):
                if (b := batch.column(1)[k].as_py()) != last:
                    last, right = b, shingles(batch.column(3)[k].as_py(), shingle)
                left = shingles(batch.column(2)[k].as_py(), shingle)
                similar.append(len(np.intersect1d(left, right, assume_unique=True)) * (NUM + DEN) >= (len(left) + len(right)) * NUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(similar, pa.bool_()))

    pairs = materialize(_possible(pairs, once), "similar-possible")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(once.select("id", "copy").join(_few(ids), "id", "left_semi"), "similar-wanted")
    texts = materialize(docs.select("copy", F.col("text").cast("binary").alias("text")).join(_few(wanted), "copy").select("id", "text").dropDuplicates(["id"]), "similar-texts")
    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"of_{c}")) for c in "ab")
    found = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(each, "a bigint, b bigint"), "similar-found")
    discard(pairs, wanted, texts)
    return found


def _by_prints(once: DataFrame) -> DataFrame:
    """(a, b): operator 6's links, from a text of each fingerprint; other texts of a fingerprint to that one."""
    prints = materialize(once.groupBy("fp").agg(F.min("id").alias("least")), "similar-prints")
    same = once.join(prints, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    left, right = (prints.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "ab")
    near = near_prints(prints.select("fp")).join(left, "a").join(right, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    return same.unionByName(near)


def _sized(posted: DataFrame) -> DataFrame:
    return posted.join(posted.groupBy("hash").agg(F.count("*").alias("size")).where("size > 1"), "hash")


def _rooted(posted: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root, the group of each id so far."""
    known = roots.select("node", F.col("root").alias("now"))
    return posted.join(known, posted.id == known.node, "left").select("hash", "id", "n", "at", F.coalesce("now", "id").alias("root"))


def roots(docs: DataFrame, marks: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, root): the groups of ids that links of similar sets join; ids without a link are left out."""
    once = materialize(marks.drop("who").dropDuplicates(["id"]), "similar-sets")
    sets = once.drop("first")
    shared = materialize(_sized(once.select("id", "n", F.posexplode("first").alias("at", "hash"))), "similar-shared")
    first = _by_prints(sets).unionByName(_paired(shared.where(F.col("size") <= SMALL))).distinct()
    known = _linked(first, docs, sets, shingle)
    joined = components(known, "similar-roots")
    rest = materialize(_rooted(shared.where(F.col("size") > SMALL), joined), "similar-rest")
    for _ in range(ROUNDS):
        if rest.isEmpty():
            break
        pivots = rest.groupBy("hash").agg(F.min(F.struct("at", "id", "root")).alias("p"))
        asked = rest.join(pivots, "hash").where("root <> p.root").select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
        new = _linked(asked, docs, sets, shingle)
        if not new.isEmpty():
            known = known.unionByName(new)
            joined = components(known, "similar-roots")
        left = _rooted(rest.join(pivots, "hash").where("id <> p.id").drop("p", "root"), joined)
        mixed = left.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hash")
        rest = materialize(left.join(mixed, "hash", "left_semi"), "similar-rest")
    if not rest.isEmpty():
        other = rest.select("hash", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("root").alias("other"))
        met = rest.join(other, "hash").where("id < b AND root <> other").where(_may(F.col("n"), F.col("at"), F.col("m"), F.col("to")))
        new = _linked(met.select(F.col("id").alias("a"), "b").distinct(), docs, sets, shingle)
        joined = joined if new.isEmpty() else components(known.unionByName(new), "similar-roots")
    return joined


def groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(who, copy, root) of every row of docs (who, copy, text): rows of one root are joined by links of similarity NUM/DEN or more.

    copy is a digest of the text. Texts without words, null ones too, are one
    group; texts of at most shingle words are similar if their words are equal.
    Words are cut and lower-cased as for fingerprints.
    """
    ship(docs.sparkSession)
    docs = docs.select("who", "copy", F.coalesce("text", F.lit("")).alias("text"))
    marks = materialize(_marks(docs, shingle, _sampled(docs, shingle)), "similar-marks")
    found = roots(docs, marks, shingle)
    return marks.join(found, marks.id == found.node, "left").select("who", "copy", F.coalesce("root", "id").alias("root"))

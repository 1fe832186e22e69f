"""Operator 13, importance resampling towards a target distribution.

Words are cut from UTF-8 bytes by a 256-byte table, which lower-cases A-Z and
blanks all that separates, and bytes.split. A run of words is hashed by CRC-32,
each longer run from the CRC of the shorter one. Counters of the hash buckets of
all documents and of the target's texts give each bucket a gain, and the drawn
documents are those with the highest sum of gains and Gumbel noise.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import materialize
from .prefix import running

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
LEAST_WORDS = 20
DRAWN_PERCENT = 5
#: Long texts are read in parts of so many bytes, cut between words.
PART_BYTES = 1_000_000

#: Letters and digits of ASCII and all bytes of other characters are parts of words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def hashes(text: bytes, longest: int = LONGEST_RUN, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """For each part of the text: its number of words, and the CRC-32 of all runs of 1 to longest words that end there."""
    text = text.translate(TABLE)
    tail: list[bytes] = []
    at = 0
    while at < len(text):
        stop = text.find(b" ", at + part_bytes) if len(text) - at > part_bytes else -1
        stop = len(text) if stop < 0 else stop
        own = (text if stop - at == len(text) else text[at:stop]).split()
        at = stop
        words = tail + own
        spaced = [b" " + w for w in words]
        last = list(map(crc32, words))
        found = last[len(tail) :]
        for k in range(1, longest):
            last = list(map(crc32, spaced[k:], last))
            found += last[max(0, len(tail) - k) :]
        tail = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
        yield len(own), np.array(found, dtype=np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """(bucket, n): how often each bucket occurs in all texts; buckets without features are left out. Null texts have none."""
    ship(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                for _, found in hashes(x.as_py() or b"", longest):
                    total.update((found % buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    own = texts.select(F.col(text).cast("string").cast("binary").alias("text")).where(F.length("text") > 0)
    return own.mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket: floor(1000 ln of its share in the target over its share in the source), each count one more than it is."""
    s, t = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((source.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)], dtype=np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """Gumbel noise of a key in thousandths, the same in each run; a null key is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST_RUN, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score) of every row: weight is the sum of its features' gains, score has the noise too."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows), dtype=np.int64)
            for i, (k, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                for n, found in hashes(x.as_py() or b"", longest):
                    out[:3, i] += n, len(found), int(gain[found % len(gain)].sum())
                out[3, i] = out[2, i] + noise(k, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["key", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(scored, f"key {kind}, n_words bigint, n_features bigint, weight bigint, score bigint").withColumnRenamed("key", key)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; rank is null for rows that are not drawn.

    Of the rows with least_words words or more, percent in a hundred (rounded
    down) are drawn: the highest scores, ties to the smaller key, then to the
    greater weight. The counts are over all documents and all target texts; what
    reaches the driver is one number a bucket. Ranks come from prefix sums over
    ranges of scores, so no task sorts all rows.

    Null and empty texts have no features and weight 0; so has everything if
    neither table has features. Null keys are noise of the empty text and come
    last among ties. Repeated rows are each scored and drawn, with ranks of their
    own. Very long texts are read in parts of a bounded size, and a target or
    table without rows counts as no features. Other columns are not read.
    """
    found = [{r.bucket: r.n for r in bucket_counts(df, column, buckets).collect()} for df, column in ((docs, text), (target, target_text))]  # a row a bucket
    rows = materialize(weighed(docs, gains(*found, buckets), key, text, seed=seed), "resample-weights")
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * percent // 100
    ranked = running(rows.where(fit), [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], {"before": F.lit(1)}, "resample-ranks")
    ranked = ranked.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1))
    out = ranked.drop("before").unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(key, "n_features", "weight", "score", "rank")

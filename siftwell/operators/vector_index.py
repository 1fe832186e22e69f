"""An index for approximate vector search: product-quantised codes, and an exact second look at the best.

A unit vector is cut into parts of a few numbers, each replaced by the number of the
nearest of 256 centroids, a byte a part. The centroids are fitted on a bounded
sample; every vector is coded. A search reads codes alone: a query's products
with all centroids are a table, and a vector's score is the sum of a byte's entries
in it. The first few hundred of each query are then scored by their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .fulltext import bounded, top_k
from .kept import kept
from .vectors import best_of

#: Numbers in a part, a byte of code: for vectors of 4-byte numbers an eighth of their size.
PART = 2
CENTROIDS = 256
#: At about so many rows, drawn by a hash of the key, the centroids are fitted.
SAMPLE_ROWS = 20_000
ROUNDS = 12
#: Coded rows and queries in a block; a block is one row of the join of both.
BLOCK, QUERIES = 16_384, 512
#: Rows of each query that are scored by their vectors.
SECOND_LOOK = 200


def usable(vector: Column, dimension: int) -> Column:
    """Whether a vector has this length and finite numbers only."""
    return (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE_ROWS, part: int = PART, seed: int = 5) -> np.ndarray:
    """Centroids (parts, centroids, part), by k-means over a sample of rows drawn by a hash of their key.

    The vectors' dimension is that of most rows of the sample, and a multiple of
    part; rows of another one are not indexed.
    """
    rows = vectors.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    drawn = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_rows / max(1, rows.count())))
    common = drawn.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common.n if common else part
    if dimension % part:
        raise ValueError(f"{dimension} numbers are not cut in parts of {part}")
    sample = np.array([r.v for r in drawn.where(usable(F.col("v"), dimension)).select("v").limit(2 * sample_rows).toLocalIterator()])
    sample = _unit(sample.reshape(-1, dimension)).reshape(-1, dimension // part, part)
    rnd, out = np.random.default_rng(seed), np.zeros((dimension // part, CENTROIDS, part))
    for p in range(out.shape[0]):
        own = sample[:, p]
        centers = own[rnd.choice(len(own), min(CENTROIDS, len(own)), replace=False)] if len(own) else out[p, :1]
        for _ in range(ROUNDS if len(own) else 0):
            near = _nearest(own, centers)
            n = np.bincount(near, minlength=len(centers))
            sums = np.stack([np.bincount(near, own[:, d], len(centers)) for d in range(part)], axis=1)
            centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
        out[p, : len(centers)], out[p, len(centers) :] = centers, centers[0]
    return out


def _nearest(own: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1) - 2 * own @ centers.T).argmin(axis=1)


def coded(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(keys array, codes binary): every usable row, some together, a row of codes each."""
    ship(vectors.sparkSession)
    parts, _, part = centroids.shape
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v"), parts * part))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                keys, v = batch.column(0).slice(a, BLOCK), batch.column(1).slice(a, BLOCK)
                m = _unit(v.flatten().to_numpy().reshape(len(v), -1)).reshape(len(v), parts, part)
                codes = np.stack([_nearest(m[:, p], centroids[p]) for p in range(parts)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([codes.tobytes()], pa.binary())], names=["keys", "codes"])

    return rows.mapInArrow(code, f"keys array<{rows.schema['key'].dataType.simpleString()}>, codes binary")


def search(index: DataFrame, centroids: np.ndarray, vectors: DataFrame, queries: DataFrame, k: int, second_look: int = SECOND_LOOK, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_key, key, score, rank): about the k most similar vectors by cosine, scores exact, ties by key.

    index: coded rows. Blocks of queries meet blocks of codes, and a block keeps
    each query's best; only the vectors of the first second_look are read. Query
    keys should be unique; queries and rows that are not usable have no neighbours.
    """
    ship(index.sparkSession)
    parts, n, part = centroids.shape
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).cast("array<double>").alias("qv")).where(usable(F.col("qv"), parts * part))
    kinds = [rows.schema[c].dataType.simpleString() for rows, c in ((queries, query_key), (vectors, key))]

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, QUERIES):
                keys, v = batch.column(0).slice(a, QUERIES), batch.column(1).slice(a, QUERIES)
                m = _unit(v.flatten().to_numpy().reshape(len(v), -1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([m.tobytes()], pa.binary())], names=["qs", "qm"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, asking = batch.column(0)[r].values, batch.column(2)[r].values
                codes = np.frombuffer(batch.column(1)[r].as_buffer(), dtype=np.uint8).reshape(len(keys), parts)
                q = np.frombuffer(batch.column(3)[r].as_buffer()).reshape(len(asking), parts, part)
                score = np.zeros((len(asking), len(keys)), dtype=np.float32)
                for p in range(parts):
                    score += (q[:, p] @ centroids[p].T).astype(np.float32)[:, codes[:, p]]
                place = np.empty(len(keys), np.int64)
                place[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                row, column = best_of(score.T, second_look, place)
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(column)), keys.take(pa.array(row)), pa.array(score.T[row, column].astype(np.float64))], names=["q", "key", "near"])

    blocks = kept(asked.mapInArrow(gathered, f"qs array<{kinds[0]}>, qm binary"), "query-blocks")
    pairs = index.select("keys", "codes").crossJoin(bounded(blocks, 4))
    near = pairs.mapInArrow(best, f"q {kinds[0]}, key {kinds[1]}, near double")
    first = kept(top_k(near, "q", [F.desc("near"), F.asc("key")], second_look).select("q", "key"), "second-look")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    seen = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).join(bounded(first), "key").join(bounded(asked, 20_000), "q")
    sizes = F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("qv"), F.col("qv")))
    scored = seen.select("q", "key", F.round(F.coalesce(dot(F.col("v"), F.col("qv")) / F.nullif(sizes, F.lit(0.0)), F.lit(0.0)), 6).alias("score"))
    ranked = top_k(scored, "q", [F.desc("score"), F.asc("key")], k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")

"""Vector search: exact cosine neighbours for a table of queries, hashing embeddings, vector tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .fulltext import top_k
from .kept import kept

#: Rows of a block, of vectors as of queries; a block is one row of the join of both.
BLOCK = 2_048


def blocks(rows: DataFrame, key: str, vector: str, size: int | None = None) -> DataFrame:
    """(keys array, n, m binary): rows with a vector, some of one length together as one matrix of unit rows (float64, row by row).

    Vectors without elements, or with one that is null or no finite number, are left out.
    """
    ship(rows.sparkSession)
    size = size or BLOCK
    source = rows.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    source = source.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                lengths = pc.list_value_length(part.column(1)).to_numpy()
                for n in np.unique(lengths):
                    at = pa.array(np.flatnonzero(lengths == n))
                    m = np.stack(part.column(1).take(at).to_numpy(zero_copy_only=False))
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    m = m / np.where(norm > 0, norm, 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).take(at).to_pylist()], pa.list_(part.column(0).type)), pa.array([len(m)], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["keys", "n", "m"])

    return source.mapInArrow(gather, f"keys array<{source.schema['key'].dataType.simpleString()}>, n int, m binary")


def best_of(score: np.ndarray, k: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each column of score (fewer, if there are fewer rows); equal scores by place."""
    rows, columns = [], []
    for q in range(score.shape[1]):
        own = score[:, q]
        at = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if len(own) > k else np.arange(len(own))
        at = at[np.lexsort((place[at], -own[at]))[:k]]
        rows.append(at)
        columns.append(np.full(len(at), q))
    return np.concatenate(rows), np.concatenate(columns)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_key, key, score, rank): the k most similar vectors by cosine, ties by key.

    Both sides are gathered into blocks, and each block of queries meets each
    block of vectors: one product of two matrices, of which k a query are kept.
    So memory follows the blocks, and the plan is the same for any number of
    queries. Queries of one block travel by broadcast; more are dealt out with the
    vectors, and both sides' blocks are written first, so that none is made twice.

    Vectors meet those of their own length alone; what blocks leaves out has no
    neighbours and is none. A zero vector has score 0 with all.
    """
    few = queries.limit(BLOCK + 1).count() <= BLOCK
    asked = blocks(queries.coalesce(1) if few else queries, query_key, query_vector).select(F.col("keys").alias("q_keys"), F.col("m").alias("q_m"))
    held = blocks(vectors, key, vector)
    pairs = held.crossJoin(F.broadcast(asked)) if few else kept(held, "vector-blocks").crossJoin(kept(asked, "query-blocks"))
    kinds = [rows.schema[c].dataType.simpleString() for rows, c in ((queries, query_key), (vectors, key))]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, asking = batch.column(0)[r].values, batch.column(3)[r].values
                m, q = (np.frombuffer(batch.column(c)[r].as_buffer()).reshape(len(x), -1) for c, x in ((2, keys), (4, asking)))
                if m.shape[1] != q.shape[1]:
                    continue
                place = np.empty(len(keys), np.int64)
                place[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                score = np.round(m @ q.T, 6)
                row, column = best_of(score, k, place)
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(column)), keys.take(pa.array(row)), pa.array(score[row, column])], names=["q", "key", "score"])

    found = pairs.select("keys", "n", "m", "q_keys", "q_m").mapInArrow(best, f"q {kinds[0]}, key {kinds[1]}, score double")
    ranked = top_k(found, "q", [F.desc("score"), F.asc("key")], k)
    return ranked.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")


def embedded(rows: DataFrame, key: str, text: str, dimension: int = 64) -> DataFrame:
    """(key, embedding array<float>): the default embedder, signed hashes of words, L2-normalised; the same anywhere."""
    ship(rows.sparkSession)

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["text"]:
                v = np.zeros(dimension, dtype=np.float64)
                for w in (x or "").lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    v[h % dimension] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.DataFrame({"key": b["key"], "embedding": out})

    source = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInPandas(embed, f"key {source.schema['key'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("key", key)

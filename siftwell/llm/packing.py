"""Operator 9, packing: concatenate all documents and cut at fixed places."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe import by_bytes, encoder
from .common import materialize

WINDOW = 1024
END_ID = 0
#: Text encoded at once: ids and the tokenizers' objects take many times the room of their text.
SLICE_BYTES = 250_000


def tokenized(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """First pass: (key, ids, n, part, before), written to the shared folder.

    ids are little-endian, two bytes each where the vocabulary allows it, with
    end_id last; part is the task's partition and before the ids that the same
    task saw earlier. As the table is written once, a task that is run again
    later reads the same order.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, total = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = code.dtype.itemsize
        for batch in batches:
            for a, b, _ in by_bytes(batch.column(1), SLICE_BYTES):
                ids = [np.array([*x, end_id], dtype=code.dtype).tobytes() for x in code.batch(batch.column(1).slice(a, b - a).to_pylist())]
                n = np.array([len(x) // width for x in ids], dtype=np.int64)
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(before)],
                    names=["key", "ids", "n", "part", "before"],
                )

    return materialize(rows.mapInArrow(encode, f"key {kind}, ids binary, n bigint, part int, before bigint"), "packing-ids")


def packed(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (key, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Two prefix sums give each document its place in the concatenation of all:
    one inside each task (already in the first pass), one over the totals of the
    partitions, a table of one row a partition. A piece ends where its document
    or its window ends; only the last window of all can be short.

    Null and empty texts: the end id alone. Repeated rows are packed as often as
    they occur; null keys are kept; an empty table gives no pieces; other
    columns are not read.
    """
    ids = tokenized(docs, vocabulary, key, text, end_id)
    kind = ids.schema["key"].dataType.simpleString()
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a partition
    first, total = {}, 0
    for part, n in totals:
        first[part] = total
        total += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            if not len(n):
                continue
            begin = batch.column(4).to_numpy() + np.array([first[p] for p in batch.column(3).to_pylist()], dtype=np.int64)
            pieces = (begin + n - 1) // window - begin // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // window + nth
            at = np.maximum(begin[row], sequence * window)
            length = np.minimum(begin[row] + n[row], (sequence + 1) * window) - at
            start = at - begin[row]
            crc = np.empty(len(row), dtype=np.int64)
            column, k = batch.column(1), 0
            for r, m in enumerate(pieces.tolist()):
                raw = column[r].as_buffer()
                width = raw.size // int(n[r])
                wide = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                for _ in range(m):
                    crc[k] = zlib.crc32(wide[start[k] : start[k] + length[k]])
                    k += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), *(pa.array(x) for x in (start, length, crc, n[row], sequence, at - sequence * window))],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    out = ids.mapInArrow(cut, f"key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)

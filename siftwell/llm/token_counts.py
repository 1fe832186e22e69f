"""Operator 1, token counts: Arrow batches in, lengths only out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .bpe import by_bytes, encoder

SLICE_BYTES = 2_000_000
LIMIT = 512


def token_counts(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, in one narrow pass.

    vocabulary is the path of a tokenizers JSON file (default: the public
    byte-level 50k one). Each Arrow batch is dealt anew into slices of about
    SLICE_BYTES bytes, so that memory follows bytes, not rows, and long texts
    are cut at safe boundaries; only lengths leave the worker.

    Null and empty texts: 0 bytes, 0 tokens. Null keys and repeated rows are
    kept as they are; an empty table gives an empty result; other columns are
    not read, so their names cannot clash.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary)
        for batch in batches:
            for a, b, sizes in by_bytes(batch.column(1), SLICE_BYTES):
                n = [len(ids) for ids in code.batch(batch.column(1).slice(a, b - a).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(count, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Operator 4, language identification by rank-order profiles.

A text's n-grams are those of 1 to 4 bytes of its lower-cased UTF-8 form; runs of
ASCII signs and digits are one blank, and all that is not ASCII counts as letters. Its TOP most frequent n-grams are
ranked (ties by n-gram), and each language's profile is the same ranking over
the language's training texts. The distance to a profile is the sum over the
text's n-grams of how far they are out of place, TOP for those it lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import fold_of, quoted

TOP = 400
MAX_N = 4
#: Training bound: about so many texts a language, drawn by a hash of the key.
SAMPLE_PER_LANG = 3_000
#: Training bound: the most frequent languages that are learned; the others' texts are ranked like any.
MAX_LANGS = 2_000
CHUNK = 1 << 20
SLICE_ROWS = 512

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of a text's n-grams; a code holds the bytes, most significant first, n-grams of all lengths apart."""
    words = text.lower().encode("utf-8", "ignore").translate(_ASCII).split()
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8)
    codes, counts = [], []
    for k in range(0, len(raw), CHUNK):
        part = raw[k : k + CHUNK + MAX_N - 1].astype(np.uint32)
        code = part
        for n in range(1, MAX_N + 1):
            if n > 1:
                if len(part) < n:
                    break
                code = (code[:-1] << np.uint32(8)) | part[n - 1 :]
            own = np.sort(code[:CHUNK])
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            codes.append(own[first])
            counts.append(np.diff(np.append(first, len(own))))
    if len(raw) > CHUNK:
        both, at = np.unique(np.concatenate(codes), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    return np.concatenate(codes), np.concatenate(counts)


def ranking(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    key = (counts.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - codes.astype(np.uint64))
    if len(key) > top:
        key = np.partition(key, len(key) - top)[-top:]
    key = np.sort(key)[::-1]
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", top: int = TOP, per_lang: int = SAMPLE_PER_LANG) -> dict[str, np.ndarray]:
    """Each language's ranking, learned from the training fold (rows whose fold is not 0) with a language and a text.

    At most about per_lang texts a language are used (a documented bound), drawn
    by a hash of the key, and the MAX_LANGS most frequent languages are learned,
    ties by name, so that a column full of other things breaks nothing. What comes to the driver is top codes a language.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where((fold_of(F.col("key")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    if not sizes:
        return {}
    # an Arrow table goes to the JVM as it is; a list would start a second daemon with workers of its own on each executor, which then stay
    shares = docs.sparkSession.createDataFrame(pa.table({"learned": pa.array(list(sizes), pa.string()), "share": pa.array([min(1.0, per_lang / n) for n in sizes.values()], pa.float64())}))
    drawn = known.join(F.broadcast(shares), F.col("lang") == F.col("learned")).where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list] = {}
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.setdefault(name, []).append(grams(x))
            for name, found in own.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([k for _, k in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counted = drawn.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counted.withColumn("place", place).where(F.col("place") <= top).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place)):
        out.setdefault(r.lang, []).append(r.code)
    return {k: np.array(v, dtype=np.uint32) for k, v in out.items()}


class Ranker:
    """Distances of one text to all profiles."""

    def __init__(self, known: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(known), top
        self.codes = np.unique(np.concatenate([known[k] for k in self.names])) if known else np.empty(0, np.uint32)
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, dtype=np.int32)
        for j, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, known[name]), j] = np.arange(len(known[name]))

    def predict(self, text: str | None) -> tuple[str, float, float, int]:
        """(language or und, score, distance, n-grams ranked).

        score is the winner's lead over the second, as a share of the second's
        distance; distance is the winner's, as a share of the largest possible.
        """
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, 1.0, 0
        own = ranking(*grams(text), self.top)
        if not len(own):
            return "und", 0.0, 1.0, 0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        place = self.places[at]
        apart = np.where(place < 0, self.top, np.abs(place - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        order = np.argsort(apart, kind="stable")
        best = int(apart[order[0]])
        rest = int(apart[order[1]]) if len(order) > 1 else self.top * len(own)
        return self.names[order[0]], (rest - best) / rest if rest else 0.0, best / (self.top * len(own)), len(own)


def identify(docs: DataFrame, known: dict[str, np.ndarray], key: str = "doc_id", text: str = "text", top: int = TOP, keep: bool = False) -> DataFrame:
    """(key, held_out, lang_pred, score, distance, n_grams) of every row, from its text alone; with keep also row, a struct of all its columns.

    Null texts and texts without a letter: und, score 0, distance 1; so is every text if no
    profile is known. Equal distances: the language first by name. Repeated rows
    and null keys are kept (a null key's fold is that of the empty text); an
    empty table gives an empty result; other columns are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), (fold_of(F.col(key)) == 0).alias("held_out"), F.col(text).cast("string").alias("text"), *([F.struct(*quoted(docs)).alias("row")] if keep else []))
    added = "lang_pred string, score double, distance double, n_grams bigint"
    schema = T.StructType([*rows.schema.fields[:2], *T.StructType.fromDDL(added).fields, *rows.schema.fields[3:]])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(known, top)
        for whole in batches:
            for a in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(a, SLICE_ROWS)
                found = list(zip(*(ranker.predict(x) for x in batch.column(2).to_pylist())))
                made = [pa.array(f, t) for f, t in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, *batch.columns[3:]], names=["key", "held_out", "lang_pred", "score", "distance", "n_grams", *batch.schema.names[3:]])

    return rows.mapInArrow(rank, schema).withColumnRenamed("key", key)

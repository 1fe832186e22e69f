"""Operator 7, media columns: bytes as PNG images, read back and hashed.

The writer lays samples out in rows and filters each row by the smallest sum of
absolute differences; the reader tests each chunk's checksum, inflates the image
data and undoes the filters with numpy. The feature is a 64-bit hash of the
low-frequency cosine transform of the image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 192
UNIT = 576
SIDE, LOW = 32, 8
#: More than any cell of a table can hold.
MAX_SAMPLES = 1 << 31
_ROWS = np.arange(LOW)[:, None]
COSINES = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * _ROWS / (2 * SIDE))


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    """raw with bytes 255 up to a positive multiple of unit."""
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """An 8-bit grey PNG of a (height, width) array; rows are stored plain, by left or by upper neighbour."""
    height, width = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    forms = (samples, left, up)
    cost = np.stack([np.abs(f.view(np.int8).astype(np.int16)).sum(axis=1) for f in forms])
    pick = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((height, width + 1), dtype=np.uint8)
    lines[:, 0] = pick
    lines[:, 1:] = np.choose(pick[:, None], forms)
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Samples of filtered lines (the first byte of each names its filter); step is the bytes of a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind = kinds[a] if a < len(kinds) else 0
        if kind == 1:
            for c in range(step):
                out[a:b, c::step] = np.add.accumulate(out[a:b, c::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            first = a - 1 if a else 0
            out[first:b] = np.add.accumulate(out[first:b], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(np.int16) if y else np.zeros(out.shape[1], np.int16)
                row = out[y].astype(np.int16)
                for x in range(out.shape[1]):
                    w, n = (row[x - step] if x >= step else 0), above[x]
                    if kind == 3:
                        guess = (w + n) // 2
                    else:
                        d = above[x - step] if x >= step else 0
                        near = w + n - d
                        guess = min((abs(near - w), 0, w), (abs(near - n), 1, n), (abs(near - d), 2, d))[2]
                    row[x] = (row[x] + guess) & 255
                out[y] = row.astype(np.uint8)
        elif kind > 4:
            raise ValueError("unknown filter")
    return out


def read_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit PNG without palette or interlace, (height, width * channels); ValueError for a damaged one."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, shape, ended = 8, [], None, False
    while at + 12 <= len(media) and not ended:
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError("chunk checksum differs")
        if kind == b"IHDR":
            width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
            if not width or not height or packing or filtering:
                raise ValueError("no pixels, or another packing")
            if depth != 8 or interlace or not channels:
                raise ValueError("only 8-bit samples without palette or interlace")
            shape = (height, width, channels)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended or shape is None:
        raise ValueError("chunks are missing")
    height, width, channels = shape
    size = height * (width * channels + 1)
    if size > MAX_SAMPLES:
        raise ValueError("too many samples")
    unpacked = zlib.decompressobj()
    raw = np.frombuffer(unpacked.decompress(b"".join(data), size + 1), dtype=np.uint8)  # never more than the header says
    if raw.size != size:
        raise ValueError("image data of another size")
    return unfiltered(raw.reshape(height, width * channels + 1), channels)


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which of the 63 lowest non-constant frequencies lie above their median, first bit unused."""
    height, width = samples.shape
    rows, columns = np.arange(SIDE) * height // SIDE, np.arange(SIDE) * width // SIDE
    small = np.add.reduceat(np.add.reduceat(samples, rows, axis=0, dtype=np.float64), columns, axis=1)
    small /= np.maximum(1, np.diff(rows, append=height))[:, None] * np.maximum(1, np.diff(columns, append=width))[None, :]
    low = np.rint(COSINES @ small @ COSINES.T * 1024).reshape(-1)  # on a grid, so that no machine's rounding shows
    bits = low[1:] > np.median(low[1:])
    return np.packbits(np.concatenate(([False], bits))).tobytes().hex()


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """(key, n_bytes, media binary): each whole text's UTF-8 bytes, padded, as a PNG; a null text is empty.

    Repeated rows and null keys are kept; an empty table gives an empty result;
    other columns are not read. Equal texts give equal bytes.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    kind = rows.schema["key"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raws = part.column(1).to_pylist()
                media = [write_png(np.frombuffer(padded(r, unit), dtype=np.uint8).reshape(-1, WIDTH)) for r in raws]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, raws)), pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    return rows.mapInArrow(store, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def from_media(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, n_bytes, media_bytes, media_sha256, payload binary, feature, error) of a media column that to_media gave or that has its columns.

    Damaged or null media give null payload and feature and say why in error; so
    do images without pixels and data that unpack to another size than the header
    says. Repeated rows and null keys are kept; an empty table gives an empty
    result; other columns are not read.
    """
    ship(media.sparkSession)
    rows = media.select(F.col(key).alias("key"), "n_bytes", F.col(column).alias("media"))
    kind = rows.schema["key"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out: list[tuple] = []
                for m in part.column(2).to_pylist():
                    try:
                        if m is None:
                            raise ValueError("no media")
                        samples = read_png(m)
                        out.append((len(m), hashlib.sha256(m).hexdigest(), samples.tobytes(), cosine_hash(samples), None))
                    except (ValueError, struct.error, zlib.error) as e:
                        out.append((None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None, None, str(e)))
                columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["key", "n_bytes", "media_bytes", "media_sha256", "payload", "feature", "error"])

    return rows.mapInArrow(read, f"key {kind}, n_bytes bigint, media_bytes bigint, media_sha256 string, payload binary, feature string, error string").withColumnRenamed("key", key)

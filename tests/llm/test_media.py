import hashlib
import zlib

import numpy as np
import pytest
from siftwell.llm import media
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def test_whole_table_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_media"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        stored = media.write_png(np.frombuffer(want, np.uint8).reshape(-1, media.WIDTH))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.feature) == 16


def filtered(samples, kind, step):
    """Lines of one filter, by its definition, a sample at a time."""
    out = np.zeros((samples.shape[0], samples.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    for y in range(samples.shape[0]):
        for x in range(samples.shape[1]):
            a = int(samples[y, x - step]) if x >= step else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out[y, x + 1] = (int(samples[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    return out


@pytest.mark.parametrize("step", [1, 3])
def test_all_filters_are_undone(step):
    rng = np.random.default_rng(step)
    samples = rng.integers(0, 256, (12, 8 * step), dtype=np.uint8)
    each = [filtered(samples, k, step) for k in range(5)]
    for lines in each:
        assert (media.unfiltered(lines, step) == samples).all()
    mixed = np.stack([each[k % 5][k] for k in range(12)])
    assert (media.unfiltered(mixed, step) == samples).all()


def test_damage_is_found(spark):
    good = media.write_png(np.arange(576, dtype=np.uint8).reshape(-1, 192))
    for bad in (good[:-5], good[:40] + b"\x00" + good[41:], b"GIF89a" + good, b""):
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bad)
    rows = spark.createDataFrame([(1, 5, bytearray(good)), (2, 5, bytearray(good[:-5])), (3, 5, None)], "doc_id bigint, n_bytes bigint, media binary")
    got = {r.doc_id: r for r in media.from_media(rows).collect()}
    assert got[1].error is None and got[2].payload is None and got[2].error and got[3].error == "no media"


def test_hash_holds_under_small_changes_and_differs_between_images():
    rng = np.random.default_rng(9)

    def image(seed):
        coarse = np.random.default_rng(seed).integers(0, 256, (8, 8)).astype(float)
        return np.kron(coarse, np.ones((16, 24)))

    one, two = image(1), image(2)
    near = np.clip(one * 0.9 + 10 + rng.normal(0, 3, one.shape), 0, 255)
    bits = [int(media.cosine_hash(x.astype(np.uint8)), 16) for x in (one, near, two)]
    assert (bits[0] ^ bits[1]).bit_count() <= 4 and (bits[0] ^ bits[2]).bit_count() >= 16


def test_edges(spark):
    rows = edge_docs(spark)
    got = media.from_media(media.to_media(rows)).collect()
    assert len(got) == rows.count() and all(r.error is None for r in got)
    assert {len(r.payload) for r in got if r.n_bytes == 0} == {576}
    assert len({r.feature for r in got if r.doc_id in (1, 5)}) == 1
    assert media.from_media(media.to_media(empty_docs(spark))).count() == 0

"""What executors hold beside the heap: the batches, the workers' tables and the workers' number."""

import numpy as np
from pyspark import SparkContext
from siftwell import shipping
from siftwell.llm import language_id, packing, similar


def test_batches_are_bounded_unless_the_session_does(spark):
    before = spark.conf.getAll.get(shipping.BATCH)
    try:
        spark.conf.unset(shipping.BATCH)
        shipping.ship(spark)
        assert spark.conf.get(shipping.BATCH) == "1m"
        spark.conf.set(shipping.BATCH, "3m")
        shipping.ship(spark)
        assert spark.conf.get(shipping.BATCH) == "3m"
    finally:
        spark.conf.unset(shipping.BATCH) if before is None else spark.conf.set(shipping.BATCH, before)


def test_frequent_shingles_take_a_bit_a_slot():
    often = np.random.default_rng(1).integers(0, 1 << 64, 5_000, dtype=np.uint64)
    slots = similar._slots(often)
    assert slots.nbytes * 8 <= similar._SLOTS
    asked = np.concatenate([often[:50], often[:50] ^ np.uint64(1), often[:50] ^ np.uint64(1 << 40), np.random.default_rng(2).integers(0, 1 << 64, 5_000, dtype=np.uint64)])
    low = {int(x) % similar._SLOTS for x in often}
    assert similar._among(slots, asked).tolist() == [int(x) % similar._SLOTS in low for x in asked]
    assert not similar._among(similar._slots(often[:0]), asked).any()


def test_languages_are_learned_in_one_kind_of_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "one two three" if k % 2 else "eins zwei drei", "en" if k % 2 else "de") for k in range(40)], "doc_id bigint, text string, lang string")

    def other(*_):
        raise AssertionError("a list of rows starts workers of another kind")

    monkeypatch.setattr(SparkContext, "parallelize", other)
    assert sorted(language_id.profiles(docs)) == ["de", "en"]


def test_texts_are_encoded_in_small_slices():
    assert packing.SLICE_BYTES <= 250_000

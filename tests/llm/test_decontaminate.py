import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from siftwell.llm.decontaminate import MASKS, contaminated, masks_for
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def words(rnd, n):
    return [f"w{rnd.randint(0, 5000)}" for _ in range(n)]


def test_finds_planted_passages_with_substitutions_and_nothing_else(spark):
    rnd = random.Random(3)
    items = [(k, " ".join(words(rnd, rnd.randint(15, 60)))) for k in range(30)]
    docs, want = [], set()
    for d in range(300):
        text = words(rnd, rnd.randint(30, 200))
        if d % 3 == 0:
            k = d // 3 % 30
            own = items[k][1].split()
            for at in rnd.sample(range(len(own)), len(own) // 10):
                own[at] = "zz"
            at = rnd.randint(0, len(text))
            text[at:at] = own
            want.add((d, k))
        docs.append((d, " ".join(w.capitalize() if rnd.random() < 0.1 else w + rnd.choice(["", ",", "."]) for w in text)))
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity >= 0.8 and r.matched / r.compared == pytest.approx(r.similarity) for r in got)


def test_masks_survive_any_three_substitutions_of_fifteen():
    from itertools import combinations

    seeds = [[p for p, c in enumerate(m) if c == "1"] for m in MASKS]
    for gone in combinations(range(15), 3):
        assert any(all(s + p not in gone for p in seed) for seed in seeds for s in range(15 - seed[-1]))


def brute(docs, items, stretch=24, least=0.8):
    """(key, text) each -> {(key, item): (doc_start, item_start, matched, compared)}, the best stretch of all alignments of all pairs."""
    ids, out = {}, {}

    def coded(text):
        return np.array([ids.setdefault(w, len(ids)) for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())], dtype=np.int64)

    coded_items = [(k, coded(t)) for k, t in items]
    for key, text in docs:
        d = coded(text)
        for item, own in coded_items:
            m = len(own)
            w = min(stretch, m)
            if not m or len(d) < w:
                continue
            pad = np.full(m - w, -1)
            equal = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, d, pad]), m) == own
            sums = np.cumsum(equal, axis=1)
            sums = np.concatenate([sums[:, w - 1 : w], sums[:, w:] - sums[:, :-w]], axis=1)
            start = np.arange(len(equal))[:, None] - (m - w) + np.arange(m - w + 1)
            sums = np.where((start >= 0) & (start + w <= len(d)), sums, -1)
            best = sums.max()
            if best >= least * w - 1e-9:
                out[key, item] = (*min((int(start[s, j]), int(j)) for s, j in np.argwhere(sums == best)), int(best), w)
    return out


def found(rows):
    return {(r[0], r[1]): (r.doc_start, r.item_start, r.matched, r.compared) for r in rows.collect()}


def test_whole_table_against_all_alignments(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and found(QUERIES["op3_decontamination"](spark, sf)) == want


def test_items_of_1_to_30_tokens_with_the_substitutions_allowed(spark):
    rnd, items, docs = random.Random(5), [], []
    for n in range(1, 31):
        own = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        width = min(24, n)
        for _ in range(12):
            copy = list(own)
            for at in rnd.sample(range(width), width - math.ceil(0.8 * width - 1e-9)):
                copy[at] = "zz"
            text = words(rnd, rnd.randint(0, 30))
            at = rnd.randint(0, len(text))
            docs.append((len(docs), " ".join([*text[:at], *copy, *text[at:]])))
    got = found(contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    want = brute(docs, items)
    assert len(want) >= 360 and got == want


def test_all_places_of_a_repeated_passage_are_tried(spark):
    rnd = random.Random(8)
    p, between, tail = words(rnd, 10), words(rnd, 40), words(rnd, 14)
    item = [*p, *between, *tail, *p]
    last = [*tail, *p]
    docs = []
    for k in range(30):
        copy = list(last)
        for at in rnd.sample(range(24), 4):
            copy[at] = "zz"
        docs.append((k, " ".join([*words(rnd, 20), *copy, *words(rnd, 20)])))
    docs += [(100 + k, " ".join(rnd.choices("ab", k=60))) for k in range(10)]
    items = [(1, " ".join(item)), (2, "a b " * 8), (3, "a a a a a a a a"), (4, "a b a a b a b b a a b")]
    got = found(contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")))
    want = brute(docs, items)
    assert {(k, 1) for k in range(30)} <= set(want) and got == want


def test_masks_hit_at_every_length():
    from itertools import combinations

    for width in range(1, 25):
        wrong = width - math.ceil(0.8 * width - 1e-9)
        placed = [{start + p for p, c in enumerate(m) if c == "1"} for m in masks_for(width) for start in range(width - len(m) + 1)]
        assert all(any(not seed & set(gone) for seed in placed) for gone in combinations(range(width), wrong)), width


def test_beyond_the_broadcast_bound_the_result_is_the_same(spark, sf, monkeypatch):
    from siftwell.llm import decontaminate

    want = sorted(map(tuple, QUERIES["op3_decontamination"](spark, sf).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ENTRIES", 0)
    assert sorted(map(tuple, QUERIES["op3_decontamination"](spark, sf).collect())) == want


def test_edges(spark):
    rows = edge_docs(spark)
    items = spark.createDataFrame([(1, "The cat sat on the mat and the dog ran away from the house today"), (1, None), (2, ""), (3, "too short"), (None, "word and more words word and more words word and more")], "item_id bigint, text string").withColumn("key", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in contaminated(rows, items).collect()}
    assert set(got) == {(1, 1), (5, 1), (4, None)}
    assert got[1, 1].doc_start == 0 and got[1, 1].similarity == 1.0
    assert contaminated(empty_docs(spark), items).count() == 0
    assert contaminated(rows, items.limit(0)).count() == 0


def test_texts_of_repeated_phrases_equal_all_alignments(spark):
    rnd = random.Random(11)
    alone = ["a " * 60, "b a " * 30, "a b c " * 15, "a a b " * 12, "x a a a a y a a a a z a a a a", "c " * 9 + "q " + "c " * 40]
    mixed = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(5, 70))) for _ in range(40)]
    docs = [(k, t) for k, t in enumerate(alone + mixed + ["a b " * 200 + "c c c " + "a " * 150])]
    items = [(k, t) for k, t in enumerate(alone[::-1] + mixed[:12])]
    got = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert found(got) == brute(docs, items)


def test_a_repeated_seed_gives_the_shifts_and_not_the_pairs_of_places(spark):
    from siftwell.llm.decontaminate import _differences, _runs

    cases = [([*range(5_000)], [*range(800)]), ([*range(0, 900, 3)], [*range(0, 60, 3)]), ([0, 1, 2, 10, 11, 12, 30], [0, 7, 9]), ([4], [0]), ([*range(0, 40, 2), 99], [*range(0, 40, 5)])]
    df = spark.createDataFrame([(k, p, a) for k, (p, a) in enumerate(cases)], "k int, p array<int>, a array<int>")
    for r in df.select("k", _differences(F.col("p"), F.col("a")).alias("d"), F.size(_runs(F.col("p"))).alias("n")).collect():
        p, a = cases[r.k]
        assert len(r.d) == len(set(r.d)) and set(r.d) == {x - y for x in p for y in a}
        assert r.k or r.n == 1

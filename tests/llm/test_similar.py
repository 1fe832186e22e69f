import random

import corpus_pipeline as p
import pytest
from siftwell.llm import similar


def words_of(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute_groups(texts):
    """texts: {key: text} -> {key: smallest key that links of Jaccard 0.8 or more reach}."""
    sets = {}
    for k, t in texts.items():
        w = words_of(t)
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 5 * o >= 4 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def changed(rnd, words, times):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9999)}"
    return words


def test_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_groups({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in p.drop_near_duplicates(spark, docs, sf).collect()} == set(want.values())


@pytest.mark.parametrize("small, rounds, often", [(24, 6, 3), (2, 6, 1), (2, 1, 1), (3, 0, 1)])
def test_large_groups_against_brute_force(spark, monkeypatch, small, rounds, often):
    """Copies of copies, so that many are similar to some of the others only."""
    for name, value in (("SMALL", small), ("ROUNDS", rounds), ("OFTEN", often), ("SAMPLE", 1)):
        monkeypatch.setattr(similar, name, value)
    rnd, texts = random.Random(small), {}
    for _ in range(4):
        known = [[f"w{rnd.randint(0, 999)}" for _ in range(rnd.choice([12, 40, 120]))]]
        for _ in range(40):
            known.append(changed(rnd, rnd.choice(known), rnd.choice([0, 1, 1, 2, 3, 5])))
        for words in known:
            texts[len(texts)] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = brute_groups(texts)
    assert {r.doc_id for r in p.drop_near_duplicates(spark, rows, "").collect()} == set(want.values())


def test_rows_without_an_id_are_searched(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    rows = [(7, text), (None, text), (None, near), (None, other), (None, other + " more"), (3, near)]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert (3, near) in kept and len(kept) == 2 and sum(r.doc_id is None for r in kept) == 1


def test_texts_that_share_an_id_are_judged_each(spark):
    words = [f"w{k}" for k in range(60)]
    text, other, third = " ".join(words), " ".join(reversed(words)), " ".join(words[::2])
    rows = [(1, text), (2, text), (2, other), (4, third), (4, third), (4, other[::-1])]
    kept = p.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(tuple, kept)) == sorted([(1, text), (2, other), (4, third), (4, other[::-1])])

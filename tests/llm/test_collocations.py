"""Operator 12 against its definition, and the trie against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siftwell.llm import collocations as C
from siftwell.llm.queries import ORACLES, QUERIES
from siftwell.llm.trie import Trie

from ..oracle import compare, connection
from .helpers import edge_docs, empty_docs


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def defined(docs, least, first=2000):
    """Rows by the definition; docs: (lang, text)."""
    out = []
    for lang in {lang or "und" for lang, _ in docs}:
        f, n = Counter(), 0
        for own, text in docs:
            if (own or "und") == lang:
                for w in pieces(text):
                    n += len(w)
                    f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        known = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in known.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:first])]
    return sorted(out)


def made(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in C.collocations(df, **options).collect())


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["New", "york", "city", "the", "a", "é", "\x01", "ß.x", "o'b", "日本"]
    lines = [" ".join(rnd.choice(words[: rnd.choice([3, 6, 10])]) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", ".", "!\n", " \t", "\r\n\x0b"]) for _ in range(n)]
    return [(rnd.choice(["en", "de", None, "und"]), " ".join(lines[i : i + 3]) if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"limit": 5}, {"buckets": 64}, {"first": 3}])
def test_equals_the_definition(spark, options):
    rows = texts(len(options))
    got, want = made(spark, rows, least=9, **options), defined(rows, 9, options.get("first", 2000))
    assert got == want and len(want) > 8


def test_candidates_are_frequent_however_full_the_tables_are(spark):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    full = [np.ones(1, dtype=bool)] * 5
    got = sorted((r.lang, bytes(r.phrase).decode()) for r in C.candidates(docs, full, least=9).collect())
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert got == sorted(p for p, n in f.items() if n >= 9) and len(got) > 8


@pytest.mark.parametrize("limit, tries", [(1000, 3), (7, 3), (7, 1), (7, 1000)])
def test_several_tries_and_passes_count_alike(spark, limit, tries):
    rows = texts(6)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    wanted = C.candidates(docs, [np.ones(1, dtype=bool)] * 5, least=9)
    got = {(r.lang, bytes(r.phrase).decode()): r.f for r in C.counts(docs, wanted, least=9, limit=limit, tries=tries).collect()}
    f = Counter()
    for lang, text in rows:
        for w in pieces(text):
            f.update((lang or "und", " ".join(w[i : i + k])) for k in range(2, 6) for i in range(len(w) - k + 1))
    assert got == {p: n for p, n in f.items() if n >= 9}


def test_words_of_hot_passages_and_overlaps(spark):
    rows = [("en", "no no no no no. no no")] * 40 + [("en", "in spite of all that")] * 60 + [("en", "spite of")] * 40
    assert made(spark, rows, least=40) == defined(rows, 40)


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    text = "".join(rnd.choice(["alpha ", "beta ", "the ", ", ", "x.", "\t"]) for _ in range(3_000))
    for size in (1, 5, 40, 1000):
        whole, seen = C.words(text.encode()) + [C.END], []
        for found, own in C.parts(text.encode(), part_bytes=size):
            assert found[own:] == whole[len(seen) + own : len(seen) + own + len(found) - own]
            assert own == len(whole) - 1 - len(seen) or len(found) - own == C.LONGEST - 1
            seen += found[:own]
        assert seen == whole[:-1]


def test_edge_cases(spark):
    docs = edge_docs(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in C.collocations(docs, least=2).collect()) == defined(rows, 2)
    assert C.collocations(empty_docs(spark)).collect() == []
    assert C.collocations(docs, least=10**9).collect() == []


def test_a_column_full_of_languages(spark):
    rows = [(f"l{i % 300}", "to be or not to be, to be") for i in range(900)]
    assert made(spark, rows, least=6) == defined(rows, 6)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    f = spark.createDataFrame([("en", "a", big), ("en", "b", big + 7), ("en", "a b", big - 1)], "lang string, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 16_000_000_000_001)], "lang string, n bigint")
    assert C.scored(f, totals).first().score == 1000 * (big - 1) * 16_000_000_000_001 // (big * (big + 7))


def rows_of(sequences):
    return np.array([[*s, *[0] * (4 - len(s))] for s in sequences], dtype=np.int32).reshape(-1, 4)


@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=4).map(tuple), max_size=60, unique=True))
@settings(max_examples=150, deadline=None)
def test_trie_knows_its_sequences_and_no_others(sequences):
    trie = Trie(rows_of(sequences))
    assert len(set(trie.nodes.tolist())) == len(sequences)
    prefixes = {()} | {s[:k] for s in sequences for k in range(len(s) + 1)}
    where = {(): trie.root}
    for p in sorted(prefixes, key=len)[1:]:
        there, to = trie.step(np.array([where[p[:-1]]]), np.array([p[-1]]))
        assert len(there) == 1
        where[p] = int(to[0])
    assert [where[s] for s in sequences] == trie.nodes.tolist() and len(set(where.values())) == len(prefixes)
    for p, node in where.items():
        there, _ = trie.step(np.full(trie.codes + 1, node), np.arange(trie.codes + 1))
        assert {p + (int(c),) for c in there} == {q for q in prefixes if len(q) == len(p) + 1 and q[:-1] == p}


def test_trie_of_many_wide_nodes():
    rnd = random.Random(5)
    sequences = sorted({tuple(int(rnd.paretovariate(0.4)) % 5_000 + 1 for _ in range(rnd.randint(1, 4))) for _ in range(30_000)})
    trie = Trie(rows_of(sequences))
    assert len(np.unique(trie.nodes)) == len(sequences) and trie.size < 12 * len(sequences)
    nodes = np.full(len(sequences), trie.root)
    first = np.array([s[0] for s in sequences])
    there, to = trie.step(nodes, first)
    assert len(there) == len(sequences) and all((trie.check[to] == trie.root).tolist())


def test_whole_table_equals_sql(spark, sf):
    sf = "/root/testdata/sf0.01"
    assert compare(spark, connection(sf), QUERIES["op12_collocations"], ORACLES["op12_collocations"], sf) is None

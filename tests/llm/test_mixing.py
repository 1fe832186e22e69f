"""Operator 11 against its definition, and its schedule against points counted one by one."""

from collections import defaultdict
from fractions import Fraction

import pytest
from siftwell.llm import mixing
from siftwell.llm.queries import ORACLES, QUERIES

from ..oracle import compare, connection
from .helpers import edge_docs, empty_docs


def shared(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """Targets by sharing the excess again and again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = {s: (left - sum(most * sizes[x] for x in full)) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if level[s] > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in full else level[s] for s in names}
        full |= above


def frame(spark, sizes, repeat=1):
    rows = [(i * 100 + j, "w " * n, source) for i, (source, ns) in enumerate(sizes) for j, n in enumerate(ns)] * repeat
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("sizes", [
    [("a", [10, 20, 3]), ("b", [1000]), (None, [7, 0, 5])], [("a", [1]), ("b", [1]), ("c", [1]), ("é", [5000, 1, 0])], [("z", [3000, 2500]), ("y", [100] * 30), ("x", [1]), (None, [9])],
    [("only", [17])], [("a", [0, 0]), ("b", [0])], [(f"s{i}", [i * 3, 40]) for i in range(40)],
])
def test_targets_and_taken_words(spark, sizes):
    got = [tuple(r) for r in mixing.mixed(frame(spark, sizes), block=16).collect()]
    own = {source: sum(ns) for source, ns in sizes}
    want = shared(own) if sum(own.values()) else dict.fromkeys(own, 0)
    source = {i * 100 + j: s for i, (s, ns) in enumerate(sizes) for j, _ in enumerate(ns)}
    assert sorted(r[0] for r in got) == sorted(source)
    taken = defaultdict(int)
    for doc_id, size, source_size, target, words in got:
        assert source_size == own[source[doc_id]] and target == pytest.approx(float(want[source[doc_id]]), rel=1e-12)
        assert 0 <= words <= 2 * size
        taken[source[doc_id]] += words
    assert taken == {s: int(t) for s, t in want.items()}


def test_slots_are_the_points_in_order(spark):
    rows = frame(spark, [("a", [100, 33]), ("b", [900]), ("c", [77, 1]), ("d", [410])])
    sources = mixing.targets(mixing.sized(rows))
    slots = sorted(mixing.schedule(sources, block=8).collect())
    quota = {r.place: -(-min(r.words, r.source_size) // 8) + -(-(r.words - r.source_size) // 8) if r.words > r.source_size else -(-r.words // 8) for r in sources.collect()}
    n = sum(quota.values())
    bits = (n - 1).bit_length()
    low, at = {}, 0
    for place in sorted(quota):
        low[place], at = at, at + quota[place]
    rank, want = defaultdict(int), []
    for i in range(2**bits):
        point = int(f"{i:0{bits}b}"[::-1], 2)
        for place in quota:
            if low[place] <= point < low[place] + quota[place]:
                want.append((i, place, rank[place]))
                rank[place] += 1
    assert [(r.slot, r.place, r["rank"]) for r in slots] == want
    seen, worst = defaultdict(int), 0
    for k, r in enumerate(slots, 1):  # at any place each source has its share, to a few slots
        seen[r.place] += 1
        worst = max(worst, *(abs(seen[p] - k * quota[p] / n) for p in quota))
    assert worst < 4


def test_the_mix_is_gapless_and_adds_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = mixing.mixture(docs, block=256).collect()
    sums, slots = defaultdict(int), defaultdict(list)
    for p in pieces:
        sums[p.doc_id] += p.length
        slots[p.slot].append((p.offset, p.length, p.source))
        assert p.length > 0 and p.start >= 0
    for own in slots.values():
        own.sort()
        assert len({s for _, _, s in own}) == 1 and [o for o, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) <= 256
    assert sums == {r.doc_id: r.taken for r in mixing.mixed(docs).collect() if r.taken}


def test_edge_cases_and_reruns(spark):
    docs = edge_docs(spark)
    first, again = (sorted(map(str, mixing.mixed(d).collect())) for d in (docs, docs.repartition(3)))
    assert first == again and len(first) == docs.count()
    assert all(r.taken == 0 for r in mixing.mixed(docs).collect() if r["size"] == 0)
    assert mixing.mixed(empty_docs(spark)).collect() == []
    assert mixing.mixture(empty_docs(spark)).collect() == []


def test_repeated_rows_and_a_hot_source(spark):
    docs = frame(spark, [("hot", [5] * 60), ("b", [50])], repeat=3)
    got = mixing.mixed(docs, block=7).collect()
    assert len(got) == 183 and sum(r.taken for r in got if r["size"] == 5) == int(shared({"hot": 900, "b": 150})["hot"])


def test_words_are_runs_between_ascii_blanks(spark):
    texts = ["", None, " ", "a", "\x0b a\x0cb\x85c d \x1ce\r\n", "x" * 10_000 + "\ty", "😀 é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.n_words(mixing.F.col("text")).alias("n"))
    import re

    assert [r.n for r in df.collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_whole_table_equals_sql(spark, sf):
    assert compare(spark, connection(sf), QUERIES["op11_source_mixing"], ORACLES["op11_source_mixing"], sf) is None

import random

import pytest
import xxhash
from pyspark.sql import functions as F
from siftwell.llm import simhash
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def brute_print(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {key: fingerprint} -> {key: smallest key reachable}."""
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, v in prints.items():
        least[find(v)] = min(k, least.get(find(v), k))
    return {k: least[find(v)] for k, v in prints.items()}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op6_simhash"](spark, sf).collect()}
    prints = {d.doc_id: brute_print(d.text) for d in docs}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == prints
    assert {k: r.component_id for k, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("small", [2, 24])
def test_links_join_what_brute_force_joins(spark, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    rnd = random.Random(small)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(40):
            prints.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3, 5]))))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()
    group = {p[0]: p[0] for p in signed} | {r.node: r.root for r in found}
    want = brute_components({p[0]: p[0] & (1 << 64) - 1 for p in signed})
    assert len(set(group.values())) == len(set(want.values()))
    pairs = {(group[k], want[k]) for k in group}
    assert len(pairs) == len(set(want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(edges).collect()
    assert {r.root for r in found} == {0} and len(found) == 301


def test_star_of_one_hub(spark):
    found = simhash.components(spark.range(1, 3000).select(F.lit(5000).cast("bigint").alias("a"), F.col("id").alias("b"))).collect()
    assert {r.root for r in found} == {1} and len(found) == 3000


def test_edges(spark):
    rows = edge_docs(spark)
    got = simhash.near_duplicates(rows).collect()
    assert len(got) == rows.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.fingerprint for k in (2, 3) for r in by[k]} == {"0" * 16} and by[3][0].component_id == 2
    assert len(by[5]) == 2 and {r.component_id for r in by[5]} == {1}
    assert by[4][0].fingerprint == f"{brute_print(rows.where('doc_id = 4').first().text):016x}"
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    alone = spark.createDataFrame([(None, "only null keys here")], "doc_id bigint, text string")
    assert simhash.near_duplicates(alone).first().component_id is None

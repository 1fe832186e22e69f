"""Operator 13 against its definition, word by word."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siftwell.llm import resample
from siftwell.llm.queries import QUERIES

from .helpers import edge_docs, empty_docs


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def defined(docs, target):
    """(doc_id, n_features, weight, score, rank) by the definition; docs: (doc_id, text)."""
    source, want = (Counter(h % 10_000 for t in texts for h in features(t)[1]) for texts in ([t for _, t in docs], target))
    s, t = sum(source.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10_000) / ((source[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for doc_id, text in docs:
        n, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x % 10_000] for x in own)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: 5 * len(fit) // 100])}
    return sorted((str((*r[:4], drawn.get(id(r)))) for r in rows))


@given(st.text(st.sampled_from("aB9 .é-😀\t\n\x85"), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_hashes_of_any_text_in_parts(text, part):
    got = list(resample.hashes(text.encode(), part_bytes=part))
    n, want = features(text)
    assert sum(k for k, _ in got) == n and Counter(x for _, a in got for x in a.tolist()) == Counter(want)


def test_whole_table_equals_the_definition(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = QUERIES["op13_importance_resampling"](spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    rows = got.collect()
    assert sorted(str(tuple(r)) for r in rows) == defined([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sum(r["rank"] is not None for r in rows) > 3


def test_edge_cases(spark):
    docs, target = edge_docs(spark), spark.createDataFrame([("a mat, a cat",), (None,), ("",)], "text string")
    got = resample.resampled(docs, target, percent=100, least_words=1).collect()
    want = {r.split(",")[0] + r.split(",")[1] + r.split(",")[2] + r.split(",")[3] for r in defined([(r.doc_id, r.text) for r in docs.collect()], ["a mat, a cat", None, ""])}
    assert len(got) == docs.count() and {x.split(",")[0] + x.split(",")[1] + x.split(",")[2] + x.split(",")[3] for x in (str(tuple(r)) for r in got)} == want
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 7
    assert resample.resampled(empty_docs(spark), target).collect() == []
    assert len(resample.resampled(docs, target.where("false")).collect()) == docs.count()


@pytest.mark.parametrize("n", [19, 20, 39, 40, 100])
def test_as_many_are_drawn_as_asked(spark, n):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(n)] + [(1000 + i, "short text") for i in range(30)] + [(0, "word " * 20)], "doc_id bigint, text string")
    got = resample.resampled(docs, docs.limit(1)).collect()
    want = defined([(r.doc_id, r.text) for r in docs.collect()], ["word " * 20])
    assert sorted(str(tuple(r)) for r in got) == want and sum(r["rank"] is not None for r in got) == 5 * (n + 1) // 100

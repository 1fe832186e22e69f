"""The stored keyword index against plain BM25, with and without blocks left out."""

import random

import pytest
from pyspark.sql import functions as F
from siftwell.functions import text as T
from siftwell.operators import fulltext, postings


def corpus(seed, n, words=400):
    rnd = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(k * 7 - 50, " ".join(rnd.choices([f"w{i}" for i in range(words)], weights, k=rnd.choice([0, 3, 20, 60, 300])))) for k in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*corpus(1, 700), (9001, None), (9002, "..."), (9003, "w1 w1 W1 w2_w3")], "doc_id bigint, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def index(docs):
    return postings.build(docs, "doc_id", "text", group=32)


def plain(docs, queries, k):
    scored = fulltext.bm25(docs, queries, "doc_id", "text", "q", "text").select("q", "doc_id", F.round(-F.col("rank_score"), 6).alias("score"))
    return sorted(tuple(r) for r in fulltext.top_k(scored, "q", [F.desc("score"), F.asc("doc_id")], k).collect())


QUERIES = [(1, "w0x w1x"), (2, "w399 w250"), (3, "www000 nothing"), (4, ""), (5, None), (6, " ".join(f"w{i:02d}0" for i in range(10, 40))), (7, "w10 w10 w200"), (8, " ".join(f"w{i}" for i in range(10, 390, 9)))]


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("k", [1, 5, 15, 2000])
def test_search_equals_plain_bm25(spark, docs, index, few, k):
    queries = spark.createDataFrame(QUERIES, "q bigint, text string")
    got = sorted((r.q, r.doc_id, r.score, r["rank"]) for r in postings.search(index, queries, "q", "text", k, 6, few).collect())
    assert got == plain(docs, queries, k) and len({g[0] for g in got}) >= 4


def test_blocks_that_cannot_reach_the_first_are_not_opened(spark):
    docs = spark.createDataFrame(corpus(5, 6000, 2000), "doc_id bigint, text string")
    index = postings.build(docs, "doc_id", "text", group=64)
    queries = spark.createDataFrame([(1, "w10 w11 w1990"), (2, "w12 w1500"), (3, "w10 w20 w30 w1700")], "q bigint, text string")
    blocks = []
    got = sorted((r.q, r.doc_id, r.score, r["rank"]) for r in postings.search(index, queries, "q", "text", 3, 6, 0, blocks).collect())
    assert got == plain(docs, queries, 3)
    known, opened, left = blocks
    assert opened < 0.5 * known and left < 200


def test_index_holds_every_posting_in_blocks_of_a_group(spark, docs, index):
    rows = index.blocks.collect()
    assert max(r.n for r in rows) <= 32 and len({(r.term, r.group) for r in rows}) == len(rows) and all(r.n == len(r.gaps) == len(r.tfs) == len(r.lens) and r.gaps == sorted(r.gaps) and r.gaps[0] == 0 for r in rows)
    got = sorted((r.term, r.first + g, t, n) for r in rows for g, t, n in zip(r.gaps, r.tfs, r.lens))
    sizes = {r.doc_id: r.len for r in fulltext.lengths(docs, "doc_id", "text").collect()}
    want = sorted((r.term, r.doc_id, r.tf, sizes[r.doc_id]) for r in fulltext.postings(docs, "doc_id", "text").collect())
    assert got == want
    assert index.n == 703


def test_keys_of_text_and_an_empty_table(spark, docs):
    named = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "text")
    index = postings.build(named, "name", "text")
    queries = spark.createDataFrame(QUERIES, "q bigint, text string")
    got = {(r.q, r.name): r.score for r in postings.search(index, queries, "q", "text", 5, 6).collect()}
    want = {(q, f"d{d}"): s for q, d, s, _ in plain(docs, queries, 2000)}
    assert got and all(want[k] == s for k, s in got.items())
    nothing = postings.build(docs.where("false"), "doc_id", "text")
    assert postings.search(nothing, queries, "q", "text", 5).collect() == []


def test_a_stemmed_index_meets_other_forms(spark):
    docs = spark.createDataFrame([(1, "running in the hills"), (2, "He runs, happily"), (3, "cafes"), (4, "nothing here"), (5, "more of nothing")], "doc_id bigint, text string")
    index = postings.build(docs, "doc_id", "text", stemmed=True)
    queries = spark.createDataFrame([(1, "run"), (2, "café"), (3, "hill running_happy")], "q bigint, text string")
    got = {(r.q, r.doc_id) for r in postings.search(index, queries, "q", "text", 5).collect()}
    assert got == {(1, 1), (1, 2), (2, 3), (3, 1), (3, 2)}
    scored = {(r.q, r.doc_id): -r.rank_score for r in fulltext.bm25_stemmed(docs, queries.where("q < 3"), "doc_id", "text", "q", "text").collect()}
    assert {(r.q, r.doc_id): pytest.approx(r.score) for r in postings.search(index, queries.where("q < 3"), "q", "text", 5).collect()} == scored


def test_documents_of_a_word(spark, docs, index):
    terms = spark.createDataFrame([("w300", 1), ("w1", 2), ("absent", 3)], "term string, n int")
    got = sorted((r.term, r.doc_id) for r in postings.documents_of(index, terms).collect())
    want = sorted((t, r.doc_id) for r in docs.select("doc_id", T.tokens(F.col("text")).alias("w")).collect() for t in ("w300", "w1") if t in (r.w or []))
    assert got == want

import random
import sqlite3

import pytest
from pyspark.sql import functions as F
from siftwell.functions import text as T
from siftwell.operators import fulltext
from siftwell.operators.stem import porter, stemmed

WORDS = "running runs ran easily connection connected connecting relational national happy happiness hopping hoping falling caresses ponies controlled possibly trouble troubling sky flies adoption activate formalize electricity triplicate probate rate cease controll roll".split()


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(7)
    return [(k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(3, 40)))) for k in range(60)]


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", corpus)
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(d, 'row')")
    con.execute("CREATE VIRTUAL TABLE plain USING fts5(text, tokenize='unicode61')")
    con.executemany("INSERT INTO plain(rowid, text) VALUES (?, ?)", corpus)
    return con


def test_stems_are_those_of_the_index(fts):
    assert {porter(w) for w in WORDS} == {r[0] for r in fts.execute("SELECT term FROM v")}


def test_bm25_is_that_of_the_index(spark, corpus, fts):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "running happy running"), (2, "Sky, roll!"), (3, "an to"), (4, "NOT hoping AND easily")], "q bigint, text string")
    got = {}
    for r in fulltext.bm25(docs, queries, "doc_id", "text", "q", "text").collect():
        got.setdefault(r.q, {})[r.doc_id] = r.rank_score
    assert set(got) == {1, 2, 4}
    for q, match in ((1, "running OR happy OR running"), (2, "sky OR roll"), (4, '"not" OR hoping OR "and" OR easily')):
        want = dict(fts.execute("SELECT rowid, rank FROM plain WHERE plain MATCH ?", (match,)))
        assert set(got[q]) == set(want)
        for k, v in want.items():
            assert got[q][k] == pytest.approx(v, rel=1e-6)


def test_stemmed_bm25_is_that_of_the_index(spark, corpus, fts):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    words = stemmed(fulltext.postings(docs, "doc_id", "text")).groupBy("doc_id", "stem").agg(F.sum("tf").alias("tf"))
    spelt = words.groupBy("doc_id").agg(F.array_join(F.flatten(F.collect_list(F.array_repeat("stem", F.col("tf").cast("int")))), " ").alias("text"))
    queries = spark.createDataFrame([(1, porter("connections") + " " + porter("hopping"))], "q bigint, text string")
    got = {r.doc_id: r.rank_score for r in fulltext.bm25(spelt, queries, "doc_id", "text", "q", "text").collect()}
    want = dict(fts.execute("SELECT rowid, rank FROM d WHERE d MATCH 'connections OR hopping'"))
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, rel=1e-6) for k, v in want.items())


def test_stemmed_search_with_accents_and_phrases_is_that_of_the_index(spark):
    rnd = random.Random(11)
    words = WORDS + ["café", "cafe", "naïve", "Éclair", "snake_case", "case_snake", "snake case", "case", "snake-cases", "running_cases"]
    corpus = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for k in range(120)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO d(rowid, text) VALUES (?, ?)", corpus)
    asked = {1: "connections hopping", 2: "CAFÉ naive eclairs", 3: "snake_case", 4: "snake_case snake cases runs snake_case", 5: "run_case ___ absent_word", 6: "an"}
    docs = spark.createDataFrame([*corpus, (999, None)], "doc_id bigint, text string").where("text IS NOT NULL")
    queries = spark.createDataFrame(list(asked.items()), "q bigint, text string")
    got = {}
    for r in fulltext.bm25_stemmed(docs, queries, "doc_id", "text", "q", "text").collect():
        got.setdefault(r.q, {})[r.doc_id] = r.rank_score
    for q, text in asked.items():
        terms = [w for w in text.split() if len(w) > 2 and w.strip("_")]
        want = dict(con.execute("SELECT rowid, rank FROM d WHERE d MATCH ?", (" OR ".join(terms),))) if terms else {}
        assert set(got.get(q, {})) == set(want), q
        for k, v in want.items():
            assert got[q][k] == pytest.approx(v, rel=1e-6)


def test_phrases_are_adjacent(spark):
    docs = spark.createDataFrame([(1, "snake_case is case snake"), (2, "case_snake"), (3, "a snake case snake case")], "doc_id bigint, text string")
    assert {r.doc_id: r.hits for r in fulltext.phrase_hits(docs, "doc_id", "text", ["snake", "case"]).collect()} == {1: 1, 3: 2}


def test_query_terms(spark):
    row = spark.createDataFrame([("The a-b ünï, OF snake_case it's AND",)], "t string").select(T.query_terms(F.col("t"))).first()[0]
    assert row == ["the", "ünï", "snake_case", "and"]

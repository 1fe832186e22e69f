"""Every registered query of the core library against its SQL; those without SQL run and keep their schema."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from siftwell.plans import search_queries
from siftwell.plans.registry import ORACLES, QUERIES

import siftwell.plans  # noqa: F401

from .oracle import TABLES, compare, connection


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def _tables(folder, sf, **own):
    """The given tables, some of them replaced."""
    for name in TABLES:
        (folder / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet") if name not in own else pq.write_table(pa.Table.from_pylist(own[name]), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["html_profile", "page_metadata"])
def test_titles_cut_off_in_an_entity_equal_sql(spark, sf, tmp_path, name):
    titles = ["One &quot", "One &quot; two", "A &lt", "A &amp", "A &am", "A &", "A &amp;lt;", "&copy; B"]
    pages = [{"page_id": i, "url": f"https://a.example/w/{i}", "html": f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>x &quot;y&quot; <a href=\"/z\">z</a></p></article></body></html>"} for i, t in enumerate(titles)]
    here = _tables(tmp_path, sf, pages=pages)
    assert compare(spark, connection(here), QUERIES[name], ORACLES[name], here) is None


def test_wiki_markup_of_texts_that_say_nothing_equals_sql(spark, sf, tmp_path):
    texts = ["One two.", None, "", " \n", "<&>", "\x1c 　", "​"]
    here = _tables(tmp_path, sf, documents=[{"doc_id": i, "text": t, "lang": "en", "source": f"src{i}", "n_chars": len(t or "")} for i, t in enumerate(texts)])
    assert compare(spark, connection(here), QUERIES["html_wiki_markup"], ORACLES["html_wiki_markup"], here) is None


@pytest.mark.parametrize("at_once", [search_queries.PASSAGE_BYTES, 2000])
def test_gold_passages_shuffle_no_document(spark, sf, con, monkeypatch, at_once):
    monkeypatch.setattr(search_queries, "PASSAGE_BYTES", at_once)
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in limits:  # as if all were too large
        spark.conf.set(name, "-1")
    try:
        found = search_queries.gold(spark, sf)
        rows = sorted(tuple(r) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert rows and rows == sorted(con.sql("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)").fetchall())
    assert "Exchange hashpartitioning" not in plan and (plan.count("BroadcastExchange") > 2) == (at_once == 2000)

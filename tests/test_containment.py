from siftwell.plans.registry import ORACLES, QUERIES

import siftwell.plans  # noqa: F401

from .oracle import compare


def test_paths_contain_sources_at_any_place(spark, tmp_path):
    sources = [(1, "wiki.org"), (2, "en.wiki.org"), (3, "x.en.wiki.org/2/a"), (4, "n"), (5, ""), (6, None), (7, "wiki.org")]
    spark.createDataFrame(sources, "doc_id bigint, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k,) for k in (1, 2, 2, 4, 5, 6, 7)], "item_id bigint").write.parquet(str(tmp_path / "benchmark.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(spark, con, QUERIES["path_containment"], ORACLES["path_containment"], str(tmp_path)) is None
    assert {r.item_id: r.n for r in QUERIES["path_containment"](spark, str(tmp_path)).collect()}[2] == 10


def test_pairs_equal_all_pairs_and_rows_follow_characters(spark):
    import random

    from siftwell.operators.containment import contained, runs

    rnd = random.Random(2)
    outer = ["".join(rnd.choice("ab/c😀") for _ in range(rnd.randint(0, 40))) for _ in range(60)] + [None, ""]
    inner = ["".join(rnd.choice("ab/c😀") for _ in range(rnd.randint(0, 6))) for _ in range(80)] + outer[:5] + [None]
    got = {(r.inner, r.outer) for r in contained(spark.createDataFrame([(x,) for x in inner], "inner string"), spark.createDataFrame([(x,) for x in outer], "outer string")).collect()}
    assert got == {(a, b) for a in inner for b in outer if a is not None and b is not None and a in b}
    nothing = spark.createDataFrame([], "inner string")
    assert contained(nothing, spark.createDataFrame([("a",)], "outer string")).collect() == []
    long = spark.createDataFrame([("".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(2000)),)], "t string")
    assert long.select(runs(long.t, 4)).first()[0].__len__() <= 1997

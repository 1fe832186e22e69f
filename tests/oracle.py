"""Compares a query's rows with its SQL's on DuckDB."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def compare(spark, con, f, sql, sf_dir):
    """None, or what differs."""
    df = f(spark, sf_dir)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} and {sorted(rel.columns)}"
    spark_rows = [tuple(canon(r[c]) for c in columns) for r in df.collect()]
    at = [rel.columns.index(c) for c in columns]
    sql_rows = [tuple(canon(r[k]) for k in at) for r in rel.fetchall()]
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} rows, SQL {len(sql_rows)}"
    a, b = sorted(spark_rows, key=repr), sorted(sql_rows, key=repr)
    for x, y in zip(a, b):
        if x != y:
            return f"{columns}\n{x}\n{y}"
    return None

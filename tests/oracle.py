"""Comparison of a query with its SQL twin on DuckDB."""

import math
import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, float):
        return f"{x + 0.0:.5f}".removesuffix(".00000")
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(map(cell, r)) for r in frame[cols].itertuples(index=False))


def duck(sql, sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con.sql(sql).df()


def same(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), duck(sql, sf)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, ([r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3])

"""Comparing a query with its SQL twin on DuckDB."""

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        if f.endswith(".parquet"):
            path = f"{DATA}/{f}/*.parquet" if os.path.isdir(f"{DATA}/{f}") else f"{DATA}/{f}"
            con.execute(f"create view {f[:-8]} as select * from '{path}'")
    return con


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.5g}"
    return str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(x) for x in r) for r in frame.itertuples(index=False)), list(frame.columns)


def same(spark, query, sql):
    got, want = rows(query(spark, DATA).toPandas()), rows(connection().execute(sql).df())
    assert got[1] == want[1]
    assert got[0] == want[0]

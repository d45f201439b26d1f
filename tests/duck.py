"""Side-by-side comparison of a query and its DuckDB SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False))


def assert_same(spark, con, query, sql, sf_dir):
    got, want = rows_of(query(spark, sf_dir).toPandas()), rows_of(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]

"""Compares a Spark frame with the rows of a DuckDB statement, whatever their order."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf=SF):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9))
    return str(v)


def same(df, sql, sf=SF):
    found = duck(sf).execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert ours == theirs

"""Rows of a Spark frame and of DuckDB in a form that can be compared."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)


def duck_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.sql(sql)
    cols = sorted(got.columns)
    at = [got.columns.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in at) for r in got.fetchall()), key=key)

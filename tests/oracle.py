"""Compares a query with its SQL, or any two results, as unordered rows."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(p):
            p = sorted(glob.glob(f"{p}/*.parquet"))
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet({p!r})")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def spark_rows(df):
    return rows(df.columns, df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())

"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("CODELODE_DATA", "/root/testdata/sf0.01")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def oracle(sql: str, folder: str = DATA):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])

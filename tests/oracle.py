"""Run a query and its SQL side by side."""

from __future__ import annotations

import decimal
import glob
import os
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, folder):
    """None when equal, else a short description; with both run times."""
    t0 = time.time()
    df = fn(spark, folder)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return (None if got[1] else "no rows"), t1 - t0, 0.0, len(got[1])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    problem = None
    made = {d[0]: str(d[1]) for d in cur.description}
    types = [(c, t, made.get(c)) for c, t in df.dtypes if SQL_TYPES.get(t, t) != made.get(c)]
    if types:
        problem = f"types {types}"
    elif got[0] != want[0]:
        problem = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        problem = f"{len(got[1])} rows != {len(want[1])}"
    elif got[1] != want[1]:
        diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        problem = f"{len(diff)} rows differ, first: {str(diff[0][0])[:400]} != {str(diff[0][1])[:400]}"
    elif not got[1]:
        problem = "no rows"
    return problem, t1 - t0, t2 - t1, len(got[1])

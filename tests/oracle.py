"""Runs registered queries beside their SQL twins: same columns, same rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x) if isinstance(x, decimal.Decimal) else x
    if isinstance(x, float):
        return None if math.isnan(x) else int(x) if x == int(x) and abs(x) < 2**53 else x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns: list[str], rows) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.cursor().execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b, key=repr)[:3]}, only in SQL {sorted(b - a, key=repr)[:3]}"
    return ""

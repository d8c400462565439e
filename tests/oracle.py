"""Compares a query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(y) for y in x) + "]"
    if isinstance(x, decimal.Decimal):
        return str(x)
    return str(x)


def same(df, con, sql: str) -> tuple[list, list]:
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return got, sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())

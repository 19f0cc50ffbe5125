"""Comparison of a Spark result with DuckDB's on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def table(rows, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    expected = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert table(df.collect(), columns) == table(expected, columns)

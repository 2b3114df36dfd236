"""A Spark query's rows against the SQL's, as multisets of values in order of column names."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)


def difference(spark, con, query, sql: str, folder: str) -> str:
    """Empty if both have the same columns and rows."""
    df = query(spark, folder)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, SQL {sorted(columns)}"
    a, b = rows(df.columns, df.collect()), rows(columns, got.fetchall())
    if a == b:
        return ""
    only = lambda x, y: sorted(set(x) - set(y))[:2]
    return f"{len(a)} rows, SQL {len(b)}; only Spark {only(a, b)}, only SQL {only(b, a)}"

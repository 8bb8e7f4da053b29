"""Side-by-side check of a registered query against its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from plumbline.catalog.base import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else (int(f) if f.is_integer() and abs(f) < 2**53 else f)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    got_names = df.columns
    got = rows_of(got_names, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(got_names) != sorted(rel.columns):
        return f"columns {sorted(got_names)} != {sorted(rel.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            cols = sorted(got_names)
            diff = {c: (a, b) for c, a, b in zip(cols, g, w) if a != b}
            return f"first difference {diff} in {dict(zip(cols, g))}"[:1500]
    return None

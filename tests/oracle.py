"""Comparing a Spark result with the same SQL run by DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def sort_key(row):
    return tuple((v is None, str(type(v).__name__ == "str"), f"{v:.6e}" if isinstance(v, (int, float)) else str(v)) for v in row)


def same(a, b) -> bool:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def difference(df, sql: str, con) -> str | None:
    """None when both give the same rows, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    expected = [tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall()]
    got = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in order]).collect()]
    if len(expected) != len(got):
        return f"{len(got)} rows against {len(expected)}"
    # Text, dates and whole numbers order the rows; floats only break ties.
    exact = [i for i, _ in enumerate(order) if not any(isinstance(r[i], float) for r in expected + got)]
    rest = [i for i in range(len(order)) if i not in exact]
    def key(r):
        return tuple((r[i] is None, str(r[i])) for i in exact), sort_key([r[i] for i in rest])
    for a, b in zip(sorted(got, key=key), sorted(expected, key=key)):
        for c, x, y in zip(order, a, b):
            if not same(x, y):
                return f"{c}: {x!r} against {y!r} in {a} / {b}"
    return None

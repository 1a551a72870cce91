"""Holding a query against its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

SF = "/root/testdata/sf0.001"


def connection(d: str):
    c = duckdb.connect()
    for f in os.listdir(d):
        name = f.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{f}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__ in ("int", "float")), x if x is not None and not isinstance(x, (int, float)) else "", x if isinstance(x, (int, float)) else 0) for x in r))


def compare(spark, d, query, sql) -> str:
    """What differs, or an empty text."""
    df = query(spark, d)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    r = connection(d).execute(sql)
    wanted_names, wanted = rows_of([x[0] for x in r.description], r.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} and {len(wanted)} rows"
    bad = [(a, b) for a, b in zip(got, wanted) if a != b]
    return f"{len(bad)} of {len(got)} rows differ: {bad[:3]}" if bad else ""

"""Runs registered queries against their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import time
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(value) + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is not None, str(type(v)), str(v)) for v in t)
    )


def compare(spark, con, function, sql, sf_dir) -> tuple[str | None, float, int]:
    """(difference or None, seconds, rows)."""
    start = time.time()
    df = function(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, took, len(got)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", took, len(got)
    if len(got) != len(want):
        extra = [r for r in got if r not in want][:2] if len(got) < 3000 else []
        lack = [r for r in want if r not in got][:2] if len(want) < 3000 else []
        return f"{len(got)} rows != {len(want)}; extra {extra} missing {lack}", took, len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ: {bad[:2]}", took, len(got)
    return None, took, len(got)

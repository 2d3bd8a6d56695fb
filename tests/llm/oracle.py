"""Compare a query with its DuckDB twin."""

from __future__ import annotations

import glob
import os

import duckdb


def tables(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "asDict"):
        return plain(tuple(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def same(df, sql, sf):
    r = tables(sf).sql(sql)
    names = sorted(df.columns)
    assert sorted(r.columns) == names, (sorted(r.columns), names)
    at = [r.columns.index(n) for n in names]
    want = sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=str)
    got = sorted((tuple(plain(row[n]) for n in names) for row in df.collect()), key=str)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)

"""Runs queries beside their SQL, as an order-free comparison of rows."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if Path(p).is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(df, sql: str, sf_dir: str) -> None:
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    got = rows(df.columns, [tuple(r.asDict(True).values()) if hasattr(r, "asDict") else tuple(r) for r in df.collect()])
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)

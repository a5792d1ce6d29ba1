"""Compares a query's rows with those of its SQL in DuckDB, by sorted columns and as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"create view {p.stem} as select * from '{source}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if all is equal, else what differs."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, want.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} rows against {sum(b.values())}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"

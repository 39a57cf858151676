"""Holds a query's rows against its SQL, run by DuckDB over the same tables."""
from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if x is not None and type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What is wrong; empty if names and rows are the same."""
    found = con.sql(sql)
    want_names, got_names = sorted(found.columns), sorted(df.columns)
    if want_names != got_names:
        return [f"columns {got_names} instead of {want_names}"]
    want = rows_of(found.columns, found.fetchall())
    got = rows_of(df.columns, df.collect())
    if want == got:
        return []
    a, b = set(got) - set(want), set(want) - set(got)
    return [f"{len(got)} rows instead of {len(want)}; only ours {sorted(a)[:2]}, only theirs {sorted(b)[:2]}"]

"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        try:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
        except Exception:
            con.register(name, pd.read_parquet(f"{sf_dir}/{name}.parquet"))
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    try:
        return round(float(x), 6) if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([tuple(_cell(r[k]) for k in order) for r in data]), key=repr)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        extra, missing = [r for r in got[:2000] if r not in want[:4000]], [r for r in want[:2000] if r not in got[:4000]]
        return f"{len(got)} and {len(want)} rows; only here {extra[:3]}, only in SQL {missing[:3]}"
    return None

"""Runs a query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if glob.glob(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if hasattr(x, "isoformat") else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, con, sf_dir, fn, sql) -> str:
    """Empty if both have the same rows."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, df.collect())
    ref = con.sql(sql)
    want = rows(ref.columns, ref.fetchall())
    if sorted(df.columns) != sorted(ref.columns):
        return f"columns {sorted(df.columns)} != {sorted(ref.columns)}"
    if got != want:
        return f"{len(got)} rows, {len(want)} wanted; first: {next(((a, b) for a, b in zip(got, want) if a != b), None)}"
    return ""

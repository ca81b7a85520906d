"""Rows of a Spark query and of a DuckDB query in one form."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float | decimal.Decimal):
        return round(float(v), 6)
    return str(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{path}'")
    got = c.execute(sql)
    names = [x[0] for x in got.description]
    columns = sorted(names)
    rows = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)

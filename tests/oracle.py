"""Compare a registered query with its SQL counterpart run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str | None:
    """None if equal, else a short account of the difference."""
    spark_columns, got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns, expected = as_rows([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != columns:
        return f"columns {spark_columns} != {columns}"
    if got == expected:
        return None
    extra, missing = got - expected, expected - got
    def show(c):
        return [tuple(str(v)[:160] for v in k) for k in sorted(c, key=str)[:2]]

    return f"rows {got.total()} vs {expected.total()}; only here {extra.total()} {show(extra)}; only there {missing.total()} {show(missing)}"

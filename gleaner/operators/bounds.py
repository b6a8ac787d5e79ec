"""Size checks that decide whether a side may be broadcast, and generators that compute their array once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fits(df: DataFrame, max_rows: int, width: Column, max_bytes: int = 64 << 20) -> bool:
    """True if the table has at most ``max_rows`` rows and their widths add up to at most ``max_bytes``."""
    # the limit keeps the check itself cheap on a large table
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("rows"), F.sum(width.cast("long")).alias("bytes")).first()
    return seen["rows"] <= max_rows and (seen["bytes"] or 0) <= max_bytes


def unnest(df: DataFrame, columns: list[str], rows: Column, proof: str) -> DataFrame:
    """Columns plus one row per element of an array of structs; ``proof`` is a field that is never null.

    The outer generator keeps the optimizer from adding a "not empty" filter below it, which would compute
    the whole array a second time, and ahead of any repartitioning.
    """
    return df.select(*columns, F.inline_outer(rows)).where(F.col(proof).isNotNull())


def small(df: DataFrame, width: Column, max_rows: int = 200_000) -> DataFrame:
    """The table with a broadcast hint if it fits, unchanged (shuffle join) otherwise."""
    return F.broadcast(df) if fits(df, max_rows, width) else df

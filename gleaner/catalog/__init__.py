"""Registered queries: each reads whole tables from a scale directory and has, where SQL can state the
same result, a counterpart for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(tables)`` under its name; ``tables("documents")`` reads one table."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                # long texts in one small file would keep a single core busy
                return spread(df) if name == "documents" else df

            return fn(table)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def load_all() -> None:
    from gleaner.catalog import chat, corpus, dedups, pages, rules, searches, site, tables, urls  # noqa: F401

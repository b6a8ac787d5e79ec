"""Listing pages of boards: recency, early stop, and detail pages overlaid with listing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import lexicon as lx
from gleaner.functions import predicates as P


def kept_listing_rows(rows: DataFrame, as_of: str = lx.RECENT_AS_OF, days: int = lx.RECENT_DAYS,
                      max_pages: int | None = None, first_page: int = 1) -> DataFrame:
    """Recent rows of the pages read before a board's listing ends.

    ``rows`` (board, page_no, date, ...). A listing ends with the first page whose rows are all old
    (its rows are still looked at) or before the first missing page. Both ends come from
    pre-aggregated minima per board, so a hot board costs no large window. ``max_pages`` (the crawl's own limit
    is ``lexicon.MAX_BOARD_PAGES``) is a choice of the caller; by default no page is left out.
    """
    marked = rows.withColumn("_recent", P.is_recent_date(F.col("date"), as_of, days))
    if max_pages is not None:
        marked = marked.where(F.col("page_no") < first_page + max_pages)
    pages = marked.groupBy("board", "page_no").agg(F.bool_or("_recent").alias("any_recent"))
    follows = pages.select("board", (F.col("page_no") + 1).alias("page_no"))
    before_first = pages.groupBy("board").agg(F.lit(first_page).cast("long").alias("page_no"))
    expected = follows.unionByName(before_first).distinct()
    gaps = expected.join(pages.select("board", "page_no"), ["board", "page_no"], "left_anti") \
        .groupBy("board").agg(F.min("page_no").alias("gap"))
    ends = pages.groupBy("board").agg(F.min(F.when(~F.col("any_recent"), F.col("page_no"))).alias("all_old"))
    limits = gaps.join(ends, "board").select("board", F.least("gap", F.col("all_old") + 1).alias("_stop"))
    return marked.where("_recent").join(limits, "board").where(F.col("page_no") < F.col("_stop")) \
        .drop("_recent", "_stop")


def overlay_listing(pages: DataFrame, rows: DataFrame, key: str = "url",
                    columns=("title", "department", "date"), null_columns=("views",)) -> DataFrame:
    """Detail pages with listing values laid over them: texts when non-empty, ``views`` when not null."""
    listed = rows.select(key, *[F.col(c).alias(f"_{c}") for c in (*columns, *null_columns)])
    joined = pages.join(listed, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)))
    for c in null_columns:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return joined.drop(*[f"_{c}" for c in (*columns, *null_columns)])

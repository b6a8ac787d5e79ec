"""Review summary of a chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T


def review_class(page_type: Column) -> Column:
    kind = T.text_or_empty(page_type)
    return (
        F.when(T.any_contains(kind, ["civil", "민원"]), "civil").when(T.any_contains(kind, ["bid", "입찰"]), "bid")
        .when(T.any_contains(kind, ["waste", "폐기물"]), "waste").otherwise("other")
    )


def class_counts(chunks: DataFrame) -> DataFrame:
    """(review_class, n) with the grand total as class "all"."""
    return chunks.groupBy(review_class(F.col("page_type")).alias("review_class")).agg(F.count("*").alias("n")) \
        .rollup("review_class").agg(F.sum("n").alias("n")) \
        .select(F.coalesce("review_class", F.lit("all")).alias("review_class"), "n")


def review_rows(chunks: DataFrame) -> DataFrame:
    """(chunk_id, review_class, title, url, safe_text) for display."""
    return chunks.select("chunk_id", review_class(F.col("page_type")).alias("review_class"), "title", "url",
                         T.escape_html(F.col("chunk_text")).alias("safe_text"))

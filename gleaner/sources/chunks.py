"""The chunk table: rebuild, idempotent load, change detection.

The table lies in buckets of the chunk id's hash, one folder each. A load looks for known ids only in the buckets that its
own ids fall in, and of these reads the id column, so a small drop does not read the whole table. The folder's name holds the
number of buckets, which a table keeps from its first rows on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from gleaner import lexicon as lx
from gleaner.functions import text as T
from gleaner.operators.dedup import keep_first
from gleaner.schemas import chunk_schema


BUCKETS = 256


def _bucket(chunk_id: str, buckets: int) -> Column:
    number = F.pmod(F.xxhash64(chunk_id), F.lit(buckets)).cast("string")
    return F.concat(F.lpad(number, 6, "0"), F.lit(f"-of-{buckets}"))


def _append(rows: DataFrame, path: str, buckets: int, mode: str = "append") -> None:
    placed = rows.select(*chunk_schema().names, _bucket("chunk_id", buckets).alias("bucket"))
    # a bucket gets one file per load
    placed.repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path)


def rebuild_table(spark: SparkSession, path: str, rows: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Drop whatever the target holds and start over (empty unless rows are given)."""
    _append(spark.createDataFrame([], chunk_schema()) if rows is None else rows, path, buckets, "overwrite")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T_.StructType([*chunk_schema().fields, T_.StructField("bucket", T_.StringType())])).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).select(*chunk_schema().names)


def table_buckets(spark: SparkSession, path: str, default: int = BUCKETS) -> int:
    """Buckets of the table at ``path``, ``default`` as long as it is empty."""
    some = _read(spark, path).select("bucket").first()
    return int(some["bucket"].split("-of-")[1]) if some else default


def known_ids(incoming: DataFrame, path: str, buckets: int) -> DataFrame:
    """``chunk_id`` of the table's rows in the buckets that the incoming ids fall in."""
    touched = [r[0] for r in incoming.where("chunk_id is not null").select(_bucket("chunk_id", buckets)).distinct().collect()]  # at most ``buckets``
    return _read(incoming.sparkSession, path).where(F.col("bucket").isin(touched)).select("chunk_id")


def loadable_chunks(incoming: DataFrame, existing: DataFrame, order: str,
                    profile: lx.SiteProfile = lx.DEFAULT_PROFILE) -> DataFrame:
    """Rows to append: known ids skipped, first row per new id, id and non-blank text required.

    The anti join comes before anything expensive, so texts of known chunks are never embedded.
    """
    body = T.strip(T.text_or_empty(F.col("chunk_text")))
    usable = incoming.where((T.text_or_empty(F.col("chunk_id")) != "") & (body != ""))
    fresh = usable.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    first = keep_first(fresh, ["chunk_id"], order, wide=True)
    none = F.array().cast("array<string>")
    return first.withColumns({
        "chunk_text": body,
        "title": F.coalesce("title", F.lit("정보 없음")),
        "page_type": F.coalesce("page_type", F.lit("contents")),
        "source": F.coalesce("source", F.lit(profile.source)),
        "menu_path": F.coalesce("menu_path", none),
        "chunk_index": F.coalesce("chunk_index", F.lit(0)),
        **{c: F.coalesce(c, F.lit("")) for c in ("major", "minor", "context")},
    })


def load_chunks(incoming: DataFrame, path: str, order: str, embed: Callable[[Column], Column] | None = None,
                profile: lx.SiteProfile = lx.DEFAULT_PROFILE, buckets: int = BUCKETS) -> None:
    """Append the loadable rows to the table at ``path``. ``embed`` maps text to an array<float> column.

    ``buckets`` counts for the first rows of a table only.
    """
    buckets = table_buckets(incoming.sparkSession, path, buckets)
    rows = loadable_chunks(incoming, known_ids(incoming, path, buckets), order, profile)
    if embed is not None:
        rows = rows.withColumn("embedding", embed(F.col("chunk_text")))
    _append(rows, path, buckets)


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(chunk_id, status): new, changed, same or gone by text hash."""
    a = old.select("chunk_id", F.col("text_hash").alias("old_hash"), F.lit(True).alias("was"))
    b = new.select("chunk_id", F.col("text_hash").alias("new_hash"), F.lit(True).alias("is"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone")
        .when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "same").otherwise("changed")
    )
    return a.join(b, "chunk_id", "full").select("chunk_id", status.alias("status"))

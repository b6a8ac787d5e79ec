"""Breadth-first expansion of seed urls over a link table."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.operators.bloom import BlockedBloom, build_bloom, shared
from gleaner.session import shared_folder, written

LABEL_LENGTH = 60  # longest label that extends a menu path


class Visited:
    """The urls taken so far, on disk in buckets of their hash, and a Bloom filter of fixed size.

    The bucket is the low bits of the hash and so is the filter's block, so every bucket has its own blocks of the
    filter. A round asks the filter inside its tasks and reads only buckets in which a url may lie; the filter gets the
    round's urls merged in. Its size does not follow the number of urls: a crowded filter only sends more urls to the exact join.
    """

    def __init__(self, spark: SparkSession, log2_buckets: int = 6, log2_blocks: int = 18):
        self.spark, self.buckets, self.log2_blocks = spark, 1 << log2_buckets, log2_blocks
        self.folder = f"{shared_folder(spark).rstrip('/')}/visited-{uuid.uuid4().hex}"
        self.bloom = BlockedBloom(np.zeros(1 << log2_blocks, np.uint64))
        self.asked: list[int] = []  # buckets read by the last ``fresh``

    def _bucket(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit(self.buckets - 1)).cast("int")

    def add(self, urls: DataFrame) -> None:
        """Take the urls of a written table."""
        rows = urls.select("url", F.xxhash64("url").alias("key")).withColumn("bucket", self._bucket(F.col("key")))
        rows.repartition("bucket").select("url", "bucket").write.mode("append").partitionBy("bucket").parquet(self.folder)
        self.bloom = BlockedBloom(self.bloom.blocks | build_bloom(rows, "key", self.log2_blocks).blocks)

    def fresh(self, urls: DataFrame) -> DataFrame:
        """The rows whose ``url`` has not been taken."""
        filter_of_all = shared(self.spark, self.bloom)
        columns = urls.columns

        def ask(batches):
            for batch in batches:
                keys = batch.column(batch.schema.get_field_index("key")).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filter_of_all.value.holds(keys))], names=[*batch.schema.names, "maybe"])

        keyed = urls.withColumn("key", F.xxhash64("url"))
        schema = T.StructType([*keyed.schema.fields, T.StructField("maybe", T.BooleanType())])
        flagged = written(keyed.mapInArrow(ask, schema).withColumn("bucket", self._bucket(F.col("key"))), "frontier-asked")
        maybe = flagged.where("maybe")
        self.asked = sorted(r[0] for r in maybe.select("bucket").distinct().collect())
        new = flagged.where("not maybe").select(*columns)
        if not self.asked:
            return new
        old = self.spark.read.schema("url string, bucket int").parquet(self.folder).where(F.col("bucket").isin(self.asked))
        return new.unionByName(maybe.join(old.select("url"), "url", "left_anti").select(*columns))


def _claimed(level: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A level without the pages that an earlier board of it shows, and the rows its boards show (None without boards).

    A board that an earlier one shows is a row of that board and shows nothing itself; the loop ends when no more boards
    fall out, which takes one look unless boards show boards.
    """
    boards = written(level.join(claims.select(F.col("board").alias("url")).distinct(), "url", "left_semi"), "frontier-boards")
    if boards.isEmpty():
        return level, None
    gone, before = boards.where("false").select("url"), 0
    while True:
        open_ = boards.join(gone, "url", "left_anti").select(
            F.col("url").alias("board"), F.col("menu_path").alias("board_path"), F.col("visit").alias("board_visit"))
        shown = written(open_.join(claims, "board"), "frontier-shown")
        seen = shown.groupBy("url").agg(F.min("board_visit").alias("first_shown"))
        taken = written(level.join(seen, "url").where("first_shown < visit").select("url"), "frontier-taken")
        gone = taken.join(boards.select("url"), "url", "left_semi")
        now = gone.count()
        if now == before:
            return level.join(taken, "url", "left_anti"), shown
        before = now


def expand_frontier(seeds: DataFrame, links: DataFrame, max_pages: int | None = None, max_rounds: int | None = None,
                    claims: DataFrame | None = None, label_length: int = LABEL_LENGTH) -> DataFrame:
    """(url, parent_url, anchor_text, menu_path, visit, depth) of the pages visited, at most ``max_pages`` if given.

    ``seeds`` (url, menu_path, seq); ``links`` (url, pos, link_url, and anchor_text or ``labels``, all labels of the link in
    order), already filtered and unique per page. Of several labels the first that extends the menu path counts.
    The visiting order is data (``visit``: the positions of the links followed), so no step needs a global
    numbering. Each round is written, which keeps lineage flat; a url is taken once, by the first page that offers
    it, also if it leads nowhere.

    ``claims`` (board, url, page_no, row_no, title): rows that listing pages show. They are visited when their board is, ahead
    of pages queued behind it, and are not expanded; they come with the columns ``page_no`` and ``row_no`` (null for
    others). A cap on pages can't be combined with them.
    """
    if claims is not None and max_pages is not None:
        raise ValueError("max_pages and claims can't be combined")
    spark = seeds.sparkSession
    # a url is visited once, so of repeated seeds the first counts
    seeds = seeds.groupBy("url").agg(F.min_by(F.struct("menu_path", "seq"), "seq").alias("s")).select("url", "s.*")
    labels = F.col("labels") if "labels" in links.columns else F.array("anchor_text")
    links = written(links.select("url", "pos", "link_url", labels.alias("labels")), "frontier-links")  # joined in every round
    level = written(seeds.select(
        "url", F.lit("").alias("parent_url"), F.try_element_at("menu_path", F.lit(-1)).alias("anchor_text"),
        "menu_path", F.array(F.col("seq").cast("long")).alias("visit"), F.lit(0).alias("depth")), "frontier")
    visited, levels, total, depth = Visited(spark), [], 0, 0
    none = [F.lit(None).cast("long").alias(c) for c in ("page_no", "row_no")]
    while True:
        if claims is not None:
            level, shown = _claimed(level, claims)
            level = level if shown is None else written(level, "frontier")
        size = level.count()
        if max_pages is not None and total + size > max_pages:
            levels.append(written(level.orderBy("visit").limit(max_pages - total), "frontier"))
            break
        levels.append(level if claims is None else level.select("*", *none))
        visited.add(level)
        total, depth = total + size, depth + 1
        if claims is not None and shown is not None:
            rows = shown.groupBy("url").agg(F.min_by(F.struct("board", "board_path", "board_visit", "title", "page_no", "row_no"),
                                                     F.struct("board_visit", "page_no", "row_no")).alias("r")).select("url", "r.*")
            rows = written(visited.fresh(rows).select(
                "url", F.col("board").alias("parent_url"), F.col("title").alias("anchor_text"),
                F.concat("board_path", F.array("title")).alias("menu_path"),
                F.concat("board_visit", F.array(F.col("page_no").cast("long"), F.col("row_no").cast("long"))).alias("visit"),
                F.lit(depth - 1).alias("depth"), F.col("page_no").cast("long"), F.col("row_no").cast("long")), "frontier-rows")
            levels.append(rows)
            visited.add(rows)
        if not size or (max_pages is not None and total >= max_pages) or (max_rounds and depth > max_rounds):
            break
        extending = F.filter("labels", lambda x: (x != "") & ~F.array_contains("menu_path", x) & (F.length(x) <= label_length))
        offers = level.select("url", "menu_path", "visit").join(links, "url").withColumn("extending", F.get(extending, F.lit(0))).select(
            F.col("link_url").alias("url"), F.col("url").alias("parent_url"),
            F.coalesce("extending", F.get("labels", F.lit(0))).alias("anchor_text"),
            F.when(F.col("extending").isNotNull(), F.concat("menu_path", F.array("extending"))).otherwise(F.col("menu_path")).alias("menu_path"),
            F.concat("visit", F.array(F.col("pos").cast("long"))).alias("visit"))
        first = offers.groupBy("url").agg(F.min_by(F.struct("parent_url", "anchor_text", "menu_path", "visit"),
                                                   "visit").alias("o")).select("url", "o.*")
        level = written(visited.fresh(first).withColumn("depth", F.lit(depth)), "frontier")
    return reduce(DataFrame.unionByName, levels)

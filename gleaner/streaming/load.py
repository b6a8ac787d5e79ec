"""Incremental chunk load: new JSON-lines files are loaded once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner import lexicon as lx
from gleaner.schemas import chunk_schema
from gleaner.sources.chunks import load_chunks


def stream_chunks(spark: SparkSession, folder: str, table: str, checkpoint: str,
                  embed: Callable[[Column], Column] | None = None, max_files: int = 1000,
                  profile: lx.SiteProfile = lx.DEFAULT_PROFILE, **trigger) -> StreamingQuery:
    """Load every file that appears in ``folder`` into ``table`` (start it with ``rebuild_table``).

    Ids already in the table are skipped, so a batch that is run again adds nothing. Lines carry no order: of
    several usable rows with one id in one file the choice is arbitrary but repeatable; between files the
    earlier path wins. Default trigger: read what is there, then stop.
    """
    source = spark.readStream.schema(chunk_schema()).option("maxFilesPerTrigger", max_files).json(folder).withColumn(
        "_order", F.concat_ws("#", F.col("_metadata.file_path"), F.lpad(
            F.col("_metadata.file_block_start").cast("string"), 20, "0"), "chunk_id", F.sha2(F.coalesce(
                "chunk_text", F.lit("")), 256)))

    def load(batch: DataFrame, _: int) -> None:
        load_chunks(batch, table, "_order", embed, profile)

    query = source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()

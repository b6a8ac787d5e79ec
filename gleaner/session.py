"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN_FOLDERS: dict[str, str] = {}


def local_session(cores: str = "*", app: str = "gleaner", **conf) -> SparkSession:
    """Session for tests and the bench. On a cluster, pass the cluster's own session instead."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a session that names none (tests, a laptop) gets a folder of its own, and then only when
    it runs in local mode; elsewhere every executor has to see the folder, so it must be named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="gleaner-")
    return _OWN_FOLDERS[app]


def spread(df: DataFrame, bytes_per_core: int = 16 << 20, rounds: int = 1) -> DataFrame:
    """Rows over all cores ahead of a costly narrow stage, if the table is small enough to lack splits.

    A table of normal size has more splits than the session has cores and is left alone. With ``rounds`` above 1 a table
    that many times larger is spread as well: narrow rows that become wide ones lie in few large row groups, hence in few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    round_ = cores * bytes_per_core
    return df.repartition(cores * (size // round_ + 1)) if size < rounds * round_ else df


def written(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a table that several later steps read, and read it back; ``compression`` as parquet names it.

    The written form has no lineage (a lost executor costs a re-read, not a recomputation), keeps
    column pruning and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(target, compression=compression)
    return spark.read.schema(df.schema).parquet(target)

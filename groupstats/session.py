"""Session settings the library reads."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HEAVY_ROWS = "spark.groupstats.heavyRows"
MAX_HEAVY = "spark.groupstats.maxHeavy"
SMALL_ROWS = "spark.groupstats.smallRows"

DEFAULTS = {HEAVY_ROWS: 1_000_000, MAX_HEAVY: 100_000, SMALL_ROWS: 100_000}


def setting(spark: SparkSession, name: str) -> int:
    """Integer setting ``name`` of the session, or its default."""
    return int(spark.conf.get(name, str(DEFAULTS[name])))


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("groupstats")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="groupstats-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared folder."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Let Spark keep checkpoints in the cluster's shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_dir(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` worked out once, for work that reads it several times: Parquet in the cluster's shared folder."""
    if any(part in df.schema.simpleString() for part in ("void", "interval")):  # Parquet has no such columns
        return cut_lineage(df)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

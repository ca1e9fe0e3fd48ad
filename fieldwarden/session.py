"""Session, table and checkpoint helpers that every module of the library shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldwarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call site for each expression
        .config("spark.sql.constraintPropagation.enabled", "false")  # relates each of a wide frame's columns to every other one
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Leaves the cluster's shared spark.checkpoint.dir alone. Where none is set, a local session gets a temporary one; a cluster has none that all its machines see."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fieldwarden-"))
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_of(frame: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions that a shuffle of the frame's rows needs so that each has about so many bytes, by the scan's estimate; never fewer than the session's."""
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = shuffle_partitions(frame.sparkSession)
    return own if size >= 1 << 60 else max(own, -(-size // bytes_each))  # a frame of no files has no estimate, which Spark gives as a huge one

"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "planlens") -> SparkSession:
    """A session with AQE, skew handling, UTC and Arrow; ``master`` is set only for local runs."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
             .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def can_cut(df: DataFrame) -> bool:
    """Whether ``checkpoint()`` has a shared folder: the one named in ``spark.checkpoint.dir``."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (named := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir() is not None


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can write: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir()

"""Helpers shared by the training-data operators: the shared folder, written tables, folds, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and the controls 9 to 13; bytes.split() uses the same set.
WORD = "[^\\x20\\x09-\\x0D]+"
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="planlens-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small, so that a worker holds a few MB of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str | Column, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``; null values give null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % mod


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII string expression, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"


def spread(df: DataFrame) -> DataFrame:
    """A small aggregate dealt out anew: a join on its key then has an exchange on both sides, which lets
    the skew rule split the hot keys of the other side."""
    return df.hint("rebalance")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root: the smallest node reachable.

    Large-star / small-star rounds: each round links the neighbours of a node to their minimum, so the number
    of rounds follows the logarithm of the longest path.  Each round is a written table.  It is over when the edges
    are stars: no node has two edges down, and none with an edge down has one coming from above.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def stars(t: DataFrame) -> bool:
        ends = (t.select("u", F.lit(1).alias("down"), F.lit(0).alias("above"))
                .unionByName(t.select(F.col("v").alias("u"), F.lit(0).alias("down"), F.lit(1).alias("above"))))
        loose = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("above").alias("above")).filter("down + above > 1 and down > 0")
        return loose.isEmpty()

    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.filter("v > u").join(spread(low), "u")
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(spread(low), "u")
        now = written(small.select("u", F.col("m").alias("v"))
                      .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

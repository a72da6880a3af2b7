"""Writers.  A partition is replaced by dynamic overwrite, so a retried job ends in the same state."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import export_columns
from ..session import shared_folder

FORMATS = ("csv", "parquet", "json")
ZSTD_LEVEL = "3"  # fixed value


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        # a quote in a cell is doubled, and blanks at its ends stay
        w.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "parquet":
        w.option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVEL).parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def clean_formats(formats: Sequence[str] | None) -> list[str]:
    out = list(dict.fromkeys(f.strip().lower() for f in (formats or []))) or ["parquet"]
    bad = [f for f in out if f not in FORMATS]
    if bad:
        raise ValueError(f"unknown formats {bad}")
    return out


def write_formats(df: DataFrame, base: str, formats: Sequence[str] | None = None) -> dict[str, str]:
    """All formats from one result; the first written copy feeds the others, so nothing is recomputed."""
    wanted = clean_formats(formats)
    paths = {f: f"{base}/{f}" for f in wanted}
    if len(wanted) == 1:
        write(df, paths[wanted[0]], wanted[0])
        return paths
    source = paths.get("parquet", f"{base}/parquet")
    write(df, source, "parquet")
    again = df.sparkSession.read.parquet(source)
    for f in wanted:
        if f != "parquet":
            write(again, paths[f], f)
    return paths


def stage(df: DataFrame, path: str) -> DataFrame:
    """Publish a raw table for later work and return it as read back."""
    write(df, path)
    return df.sparkSession.read.parquet(path)


def export_csv(df: DataFrame, path: str, max_rows: int | None = None, headers: Mapping[str, str] | None = None) -> None:
    """Query result as CSV with BOM and CRLF; only visible columns under their header names."""
    out = export_columns(df, headers or {c: c for c in df.columns})
    first = out.columns[0]
    out = (out if max_rows is None else out.limit(max_rows)).withColumnRenamed(first, "﻿" + first)
    out.write.mode("overwrite").options(header=True, escape='"', lineSep="\r\n", emptyValue="").csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def merge_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` wins by key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def _overwrite_partitions(df: DataFrame, path: str, partition: Sequence[str]) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def load_facts(df: DataFrame, path: str, keys: Sequence[str], mode: str = "merge", partition: str = "period_id") -> None:
    """``replace``: the periods present in ``df`` are replaced.  ``merge``: rows win by key.

    Only the touched periods are read and rewritten.  Spark cannot overwrite a path that the same
    plan reads, so a merge is staged in the shared folder first, under a name of its own.
    """
    spark = df.sparkSession
    if mode == "replace" or not _exists(spark, path):
        _overwrite_partitions(df, path, [partition])
        return
    if mode != "merge":
        raise ValueError(f"unknown mode {mode!r}")
    old = spark.read.parquet(path).join(df.select(partition).distinct(), partition, "left_semi")
    staged = f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}"
    write(merge_rows(old.select(*df.columns), df, keys), staged)
    _overwrite_partitions(spark.read.parquet(staged), path, [partition])


def upsert_values(df: DataFrame, path: str) -> None:
    """Indicator values: each (indicator, period) present in ``df`` is replaced whole, so organizations
    that are no longer there disappear."""
    _overwrite_partitions(df, path, ["indicator_id", "period_id"])


def upsert_rows(target: DataFrame, df: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The upsert as a pure function: ``target`` without the scopes of ``df``, plus ``df``."""
    return target.join(df.select(*scope).distinct(), list(scope), "left_anti").unionByName(df)


def save_snapshot(df: DataFrame, path: str, import_id: str) -> None:
    """Append-only snapshot; saving the same import again rewrites only that import."""
    _overwrite_partitions(df.withColumn("import_id", F.lit(import_id)), path, ["import_id"])


def read_snapshot(spark: SparkSession, path: str, import_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("import_id") == import_id)

"""Train / test / valid splits and folds.  A shuffle is an order by a seeded hash of the row id, so a
split is exact, repeatable, and independent of how the table is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan

NAMES = ["train", "test", "valid"]


def _rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def _label(fracs: Sequence[float]) -> Column:
    """``fracs``: shares of train and, for a three-way split, test; the last part takes the rest."""
    n, rn = F.col("__n"), F.col("__rn")
    first = _rounded(n * fracs[0])
    e = F.when(rn <= first, NAMES[0])
    if len(fracs) == 1:
        return e.otherwise(NAMES[1])
    return e.when(rn <= first + _rounded(n * fracs[1]), NAMES[1]).otherwise(NAMES[2])


def _positions(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    one = F.lit(1).cast("long")
    return scan(df, {"__rn": ("sum", one), "__n": ("total", one)}, order_by, partition_by)


def _shuffled(df: DataFrame, ids: Sequence[str], seed: int | None) -> tuple[DataFrame, list[str]]:
    if seed is None:
        return df, list(ids)
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *[F.col(c) for c in ids])), ["__h", *ids]


def random_split(df: DataFrame, ids: Sequence[str], fracs: Sequence[float], seed: int | None = 42) -> DataFrame:
    """Adds ``split``; ``seed=None`` keeps the id order."""
    d, order = _shuffled(df, ids, seed)
    return _positions(d, order).withColumn("split", _label(fracs)).drop("__h", "__rn", "__n")


def stratified_split(df: DataFrame, by: str, ids: Sequence[str], fracs: Sequence[float], seed: int | None = 42) -> DataFrame:
    """Shares are rounded within each stratum."""
    d, order = _shuffled(df, ids, seed)
    return _positions(d, order, [by]).withColumn("split", _label(fracs)).drop("__h", "__rn", "__n")


def time_split(df: DataFrame, date: str, ids: Sequence[str], fracs: Sequence[float]) -> DataFrame:
    """Earliest rows train, null dates last."""
    d = df.withColumn("__null", F.col(date).isNull())
    return _positions(d, ["__null", date, *ids]).withColumn("split", _label(fracs)).drop("__null", "__rn", "__n")


def group_split(df: DataFrame, by: str, fracs: Sequence[float], seed: int | None = 42) -> DataFrame:
    """Whole groups go to one part; shares count groups.  Rows without a group form one group."""
    groups, order = _shuffled(df.select(by).distinct(), [by], seed)
    parts = _positions(groups, order).select(F.col(by).alias("__g"), _label(fracs).alias("split"))
    return df.join(parts, F.col(by).eqNullSafe(F.col("__g")), "left").drop("__g")


def kfold(df: DataFrame, k: int, ids: Sequence[str], seed: int | None = 42) -> DataFrame:
    """Adds ``fold`` 1..k; the last fold takes the remainder."""
    d, order = _shuffled(df, ids, seed)
    size = F.nullif(F.floor(F.col("__n") / k), F.lit(0))
    fold = F.least(F.lit(k), F.coalesce(F.floor((F.col("__rn") - 1) / size) + 1, F.lit(k)))
    return _positions(d, order).withColumn("fold", fold.cast("int")).drop("__h", "__rn", "__n")

"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_LABEL = "(пусто)"  # fixed value: label of a null group key in charts


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def number(c: str | Column) -> Column:
    """Double value of a column, null where it is missing, not a number, or not finite."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def present(df: DataFrame, name: str) -> Column:
    """Not null and, for text, not the empty string."""
    c = F.col(name)
    return c.isNotNull() & (c != "") if isinstance(type_of(df, name), T.StringType) else c.isNotNull()


def label(name: str, empty: str = EMPTY_LABEL) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(empty))


def dealt(aggregate: DataFrame) -> DataFrame:
    """An aggregate on the key of the join it enters, dealt out anew.

    As it stands it has no exchange of its own for that join, and AQE then leaves the hot keys of the other side
    whole.  The rows dealt are one per group; a small table is still broadcast at run time.
    """
    return aggregate.hint("rebalance")


def keyed(df: DataFrame) -> DataFrame:
    """A join's right side that grows with the data while its planned size stays small: exploded, or well packed in its file.

    Planned sizes do not count what ``explode`` multiplies, so such a table would be broadcast whole from the driver into
    every task.  Here both sides meet by key, and a task hashes its share of this side; the other side is not sorted.
    """
    return df.hint("shuffle_hash")


_COLLECT: ContextVar[bool] = ContextVar("collect_statistics", default=False)


@contextmanager
def collected_statistics() -> Iterator[None]:
    """Inside, one-row aggregates run at once and enter the plan as literals.

    A chain of steps stays linear that way: as subqueries, each step's statistics would repeat all
    earlier steps, twice as much work per step.
    """
    token = _COLLECT.set(True)
    try:
        yield
    finally:
        _COLLECT.reset(token)


def _literal(value: Any, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value])
    return F.lit(value).cast(kind)


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct column: a scalar subquery, so no cross join and nothing collected."""
    if _COLLECT.get():
        row = df.head()
        return F.struct(*[_literal(row[f.name], f.dataType).alias(f.name) for f in df.schema.fields])
    return df.select(F.struct("*").alias("s")).scalar()


def bounded_values(df: DataFrame, name: str, limit: int) -> Column:
    """Sorted distinct values as one array; fails, never cuts, when there are more than ``limit``."""
    found = df.select(F.col(name).alias("v")).filter("v IS NOT NULL").distinct().limit(limit + 1)
    arr = found.agg(F.sort_array(F.collect_set("v")).alias("a"))
    message = F.lit(f"more than {limit} distinct values in {name}")
    return arr.select(F.when(F.size("a") > limit, F.raise_error(message).cast(arr.schema["a"].dataType))
                      .otherwise(F.col("a")).alias("a")).scalar()


def rnd(c: str | Column, digits: int = 0) -> Column:
    """Half away from zero on the scaled value: decides ties by the double itself, not by its decimal text."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col) if digits == 0 else F.round(col * float(10 ** digits)) / float(10 ** digits)


def percent(num: Column, den: Column, digits: int = 2) -> Column:
    """num / den * 100, null when the denominator is null or not positive."""
    return F.when(den > 0, F.round(num / den * float(10 ** (digits + 2))) / float(10 ** digits))

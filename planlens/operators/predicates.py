"""Filters.  Every function builds plain predicates, so they reach the parquet scan where they can."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, type_of

DUP = "__dup__"  # suffix that lets one column carry several filters

# fixed values: operator names of older saved queries
LEGACY = {"eq": "==", "neq": "!=", "gt": ">", "lt": "<", "like": "ilike", "null": "isNull", "notnull": "isNotNull"}

COMPARE = {">": operator.gt, "<": operator.lt, "==": operator.eq, "!=": operator.ne, "<=": operator.le,
           ">=": operator.ge}


def escape_like(value: str) -> str:
    return value.replace("\\", "\\\\").replace("_", "\\_")


def _compare(c: Column, spec: Mapping[str, Any], conv) -> Column:
    op = spec["operator"]
    if op == "between":
        if spec.get("valueFrom") is None or spec.get("valueTo") is None:
            return F.lit(False)
        return c.between(conv(spec["valueFrom"]), conv(spec["valueTo"]))
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    return F.lit(False) if spec.get("value") is None else COMPARE[op](c, conv(spec["value"]))


def _null_test(c: Column, op: str) -> Column | None:
    return c.isNull() if op == "isNull" else c.isNotNull() if op == "isNotNull" else None


def number_predicate(df: DataFrame, field: str, spec: Mapping[str, Any]) -> Column:
    c = F.col(field) if isinstance(type_of(df, field), T.NumericType) else number(field)
    test = _null_test(number(field), spec["operator"])
    return test if test is not None else _compare(c, spec, F.lit)


def date_predicate(df: DataFrame, field: str, spec: Mapping[str, Any]) -> Column:
    """Day grain.  Written as half-open ranges over the raw column so that the scan can use them."""
    kind = type_of(df, field)
    if isinstance(kind, T.StringType):
        c = F.col(field).try_cast("date")
        test = _null_test(c, spec["operator"])
        return test if test is not None else _compare(c, spec, lambda v: F.lit(v).cast("date"))
    test = _null_test(F.col(field), spec["operator"])
    if test is not None:
        return test
    c, op = F.col(field), spec["operator"]

    def day(v, plus: int = 0) -> Column:
        return F.date_add(F.lit(v).cast("date"), plus).cast(kind)

    if op == "between":
        if not spec.get("valueFrom") or not spec.get("valueTo"):
            return F.lit(False)
        return (c >= day(spec["valueFrom"])) & (c < day(spec["valueTo"], 1))
    v = spec.get("value")
    if not v:
        return F.lit(False)
    ranges = {">": lambda: c >= day(v, 1), "<": lambda: c < day(v), ">=": lambda: c >= day(v),
              "<=": lambda: c < day(v, 1), "==": lambda: (c >= day(v)) & (c < day(v, 1))}
    return ranges[op]()


def datetime_predicate(df: DataFrame, field: str, spec: Mapping[str, Any]) -> Column:
    """``==`` compares to the minute, the other operators compare the full timestamp."""
    kind = T.TimestampNTZType() if isinstance(type_of(df, field), T.StringType) else type_of(df, field)
    c = F.col(field).try_cast(kind)
    test = _null_test(c, spec["operator"])
    if test is not None:
        return test
    if spec["operator"] == "==":
        if not spec.get("value"):
            return F.lit(False)
        start = F.date_trunc("minute", F.lit(spec["value"]).cast(kind)).cast(kind)
        return (c >= start) & (c < start + F.expr("INTERVAL 1 MINUTE"))
    return _compare(c, spec, lambda v: F.lit(v).cast(kind))


def pad_time(c: Column) -> Column:
    """``H:MM`` or ``HH:MM`` text to ``HH:MM:SS``."""
    t = F.trim(c)
    t = F.when(t.rlike(r"^\d:"), F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(F.length(t) == 5, F.concat(t, F.lit(":00"))).otherwise(t)


def time_predicate(df: DataFrame, field: str, spec: Mapping[str, Any]) -> Column:
    raw = F.when(F.col(field) != "", F.col(field))
    test = _null_test(raw, spec["operator"])
    return test if test is not None else _compare(pad_time(raw), spec, lambda v: pad_time(F.lit(v)))


def string_predicate(df: DataFrame, field: str, spec: Mapping[str, Any], contains: bool = False) -> Column:
    c, op, v = F.col(field).cast("string"), spec["operator"], spec.get("value")
    if op == "isNull":
        return c.isNull() | (c == "")
    if op == "isNotNull":
        return c != ""
    if v is None:
        return F.lit(False)
    if op in ("==", "categoryEquals"):
        return c == v
    if op in ("!=", "categoryNotEquals"):
        return c != v
    if op == "ilike":
        if v == "":
            return F.lit(False)
        return c.ilike(f"%{escape_like(v)}%" if contains else escape_like(v))
    raise ValueError(f"unknown operator {op!r}")


def has_part(c: str, separator: str, value: str) -> Column:
    """True when a trimmed part of a delimited text equals ``value``, ignoring case."""
    pattern = escape_like(value).replace("%", "\\%")
    return F.exists(F.split(F.col(c), separator), lambda p: F.trim(p).ilike(pattern))


def lacks_part(c: str, separator: str, value: str) -> Column:
    """Null text has no parts, so it lacks every value."""
    return ~F.coalesce(has_part(c, separator, value), F.lit(False))


PREDICATES = {"number": number_predicate, "date": date_predicate, "datetime": datetime_predicate,
              "time": time_predicate, "string": string_predicate}


def build_predicate(
    df: DataFrame, filters: Mapping[str, Mapping[str, Any]], contains: bool = False,
    multi_value: Mapping[str, str] | None = None,
) -> Column:
    """AND of all filters; several ``categoryEquals`` on one column are OR-ed.

    ``contains`` gives the query-side meaning: ``ilike`` finds a substring, and the older operator
    names compare text.  ``multi_value`` maps delimited columns to their separator regex.
    """
    chosen: dict[str, list[Any]] = {}
    terms: list[Column] = []
    for key, spec in filters.items():
        field = key.split(DUP)[0]
        if field not in df.columns:
            raise ValueError(f"unknown column {field!r}")
        op = spec["operator"]
        if op in LEGACY:
            spec = {**spec, "type": "string", "operator": LEGACY[op]}
        kind = spec["type"]
        if multi_value and field in multi_value and spec["operator"] in ("categoryEquals", "categoryNotEquals"):
            test = has_part if spec["operator"] == "categoryEquals" else lacks_part
            terms.append(test(field, multi_value[field], spec["value"]))
        elif kind == "string" and op == "categoryEquals":
            chosen.setdefault(field, []).append(spec["value"])
        elif kind == "string":
            terms.append(string_predicate(df, field, spec, contains))
        elif kind in PREDICATES:
            terms.append(PREDICATES[kind](df, field, spec))
        else:
            raise ValueError(f"unknown filter type {kind!r}")
    terms += [F.col(f).cast("string").isin(vs) for f, vs in chosen.items()]
    return functools.reduce(operator.and_, terms, F.lit(True))


def apply_filters(df: DataFrame, filters: Mapping[str, Mapping[str, Any]], **kw: Any) -> DataFrame:
    return df.filter(build_predicate(df, filters, **kw))


def hide_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is neither null nor ''."""
    out = df.dropna("any", subset=list(cols))
    for c in cols:
        if isinstance(type_of(df, c), T.StringType):
            out = out.filter(F.col(c) != "")
    return out


def widget_filter(df: DataFrame, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """``{field, kind: select, values}`` or ``{field, kind: range, min, max}`` with open ends."""
    for f in filters:
        if f["kind"] == "select":
            if f.get("values"):
                df = df.filter(F.coalesce(F.col(f["field"]).cast("string"), F.lit("")).isin(list(f["values"])))
            continue
        v = number(f["field"])
        df = df.filter(v.isNotNull())
        if f.get("min") is not None:
            df = df.filter(v >= f["min"])
        if f.get("max") is not None:
            df = df.filter(v <= f["max"])
    return df


def cross_filter(df: DataFrame, field: str, value: Any) -> DataFrame:
    """Rows matching a clicked value; numbers compare as numbers."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return df.filter(number(field) == float(value))
    return df.filter(F.col(field).cast("string") == str(value))


def effective_predicate(date: str | Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    d = F.lit(date).cast("date") if isinstance(date, str) else date
    return (F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) >= d))


def effective_at(df: DataFrame, date: str | Column, start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    return df.filter(effective_predicate(date, start, end))

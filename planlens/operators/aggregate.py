"""Grouped aggregation, distinct values, sets and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, rnd, type_of
from .quantiles import quantiles

FUNCS = {"SUM": lambda v: F.coalesce(F.sum(v), F.lit(0.0)), "AVG": lambda v: rnd(F.avg(v), 4),
         "MIN": F.min, "MAX": F.max}


def group_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[tuple[str, str]]) -> DataFrame:
    """GROUP BY with ``_count`` and ``FUNC(field)`` columns; null and '' keys are one group.

    Values that are not numbers are skipped; AVG has 4 digits, an empty SUM is 0.
    """
    grouped = df.groupBy(*[(F.coalesce(F.col(k), F.lit("")) if isinstance(type_of(df, k), T.StringType)
                            else F.col(k)).alias(k) for k in keys])
    out = [F.count(F.lit(1)).alias("_count")]
    for field, func in aggs:
        out.append((F.count(F.lit(1)) if func == "COUNT" else FUNCS[func](number(field))).alias(f"{func}({field})"))
    return grouped.agg(*out)


def distinct_values(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """The distinct values as text, in order (a pick list); the first n if that is given."""
    values = df.select(F.col(col).cast("string").alias("value")).filter("value IS NOT NULL").distinct().orderBy("value")
    return values if n is None else values.limit(n)


def unique_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n): every distinct non-empty value, as rows rather than one array per column."""
    return (df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
            .filter("value IS NOT NULL AND value <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def unique_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, unique): exact distinct count per column."""
    return unique_values(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("unique"))


def capped_count(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Row count for paging (total, capped): exact, or at most ``cap`` if that is given."""
    total = (df if cap is None else df.limit(cap)).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("capped", F.lit(False) if cap is None else F.col("total") >= cap)


def prefix_group(c: Column) -> Column:
    ch = F.substring(F.trim(c), 1, 1)
    return (F.when(ch.rlike(r"^[0-9]$"), ch).when(ch.rlike(r"^[A-Za-zА-Яа-яЁё]$"), F.upper(ch)).otherwise("#"))


def group_by_prefix(df: DataFrame, col: str) -> DataFrame:
    """(group, value, group_order) of distinct trimmed values: digits, letters, then ``#``."""
    v = F.trim(F.col(col).cast("string"))
    out = df.select(v.alias("value")).filter("value <> ''").distinct().withColumn("group", prefix_group(F.col("value")))
    order = F.when(F.col("group").rlike("^[0-9]$"), 0).when(F.col("group") == "#", 2).otherwise(1)
    return out.withColumn("group_order", order)


# fixed values: ICD-9 chapter limits
ICD9_STARTS = [1, 140, 240, 280, 290, 320, 390, 460, 520, 580, 630, 680, 710, 740, 760, 780, 800]
ICD9_LAST = 999


def icd9_chapter(c: Column) -> Column:
    """Struct (group, group_order) of an ICD-9 code: 17 numeric chapters, EV, OTHER."""
    code = F.upper(F.trim(c))
    num = F.regexp_extract(code, r"^\D*(\d{1,3})", 1).try_cast("int")
    ends = [s - 1 for s in ICD9_STARTS[1:]] + [ICD9_LAST]
    n = len(ICD9_STARTS)
    e = F.when(code.rlike("^[EV]"), F.struct(F.lit("EV").alias("group"), F.lit(n).alias("group_order")))
    for i, (a, b) in enumerate(zip(ICD9_STARTS, ends)):
        e = e.when(num.between(a, b), F.struct(F.lit(f"{a:03d}-{b:03d}").alias("group"), F.lit(i).alias("group_order")))
    return e.otherwise(F.struct(F.lit("OTHER").alias("group"), F.lit(n + 1).alias("group_order")))


def icd9_group(df: DataFrame, col: str) -> DataFrame:
    """(group, group_order, value) of distinct codes."""
    v = F.trim(F.col(col).cast("string"))
    return (df.select(v.alias("value")).filter("value <> ''").distinct()
            .withColumn("__g", icd9_chapter(F.col("value"))).select("__g.group", "__g.group_order", "value"))


def guarded_denominator(df: DataFrame, keys: Sequence[str], counted: Column, num: str, den: str) -> DataFrame:
    """Sums over counted organizations; the denominator only when each of them has one."""
    has = counted & F.col(den).isNotNull()
    return df.groupBy(*keys).agg(
        F.sum(F.when(counted, F.col(num))).alias("numerator"),
        F.count(F.when(counted, F.lit(1))).alias("organizations"),
        F.count(F.when(has, F.lit(1))).alias("with_denominator"),
        F.sum(F.when(has, F.col(den))).alias("__den"),
    ).withColumn("denominator", F.when((F.col("organizations") > 0) & (F.col("organizations") == F.col("with_denominator")),
                                       F.col("__den"))).drop("__den")


def unpivot_facts(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], type_name: str = "type_code", value: str = "document_count") -> DataFrame:
    """Wide report to sparse facts: one row per non-zero type column."""
    return df.unpivot(list(id_cols), list(cols), type_name, value).filter(F.col(value) > 0)


def group_numerator(facts: DataFrame, groups: DataFrame, rule: str, org: str, typ: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Numerator per organization over column groups.

    ``groups``: (group_key, position, type).  Rule ``sum`` adds all groups; ``max`` takes the one
    group with the largest regional total (ties: first position).
    """
    joined = facts.join(groups, typ, "inner")
    per = joined.groupBy(*keys, "group_key", "position", org).agg(F.sum(value).alias("n"))
    if rule == "max":
        best = (per.groupBy(*keys, "group_key", "position").agg(F.sum("n").alias("t"))
                .groupBy(*keys).agg(F.max_by("group_key", F.struct("t", -F.col("position"))).alias("best")))
        if keys:
            per = per.join(best, list(keys)).filter("group_key = best").drop("best")
        else:
            per = per.filter(F.col("group_key") == best.select("best").scalar())
    elif rule != "sum":
        raise ValueError(f"unknown rule {rule!r}")
    return per.groupBy(*keys, org).agg(F.sum("n").alias("numerator"))


def rule_at(rules: Sequence[Mapping], date: str) -> str:
    """The rule in force at a reporting date: the newest ``from`` not after it."""
    live = [r for r in rules if r["from"] <= date]
    return max(live, key=lambda r: r["from"])["rule"] if live else rules[0]["rule"]


# --- set operations ---------------------------------------------------------------------------

def set_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys added and removed between two tables."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return (b.join(a, list(keys), "left_anti").withColumn("change", F.lit("added"))
            .unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("removed"))))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_semi")


def duplicates(df: DataFrame) -> DataFrame:
    """``members``: rows that have a twin; ``extras``: rows beyond the first of each group."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c")).agg(
        F.coalesce(F.sum(F.when(F.col("__c") > 1, F.col("__c"))), F.lit(0)).alias("members"),
        F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("extras"))


# --- chart aggregates -------------------------------------------------------------------------

def agg_column(df: DataFrame, field: str, fn: str) -> Column:
    v = number(field)
    raw = F.when(F.col(field).cast("string") != "", F.col(field))
    if fn == "count":
        return F.count(raw)
    if fn == "count_distinct":
        return F.count_distinct(raw)
    if fn in ("min", "max"):
        f = F.min if fn == "min" else F.max
        if isinstance(type_of(df, field), T.NumericType):
            return rnd(f(v), 4)
        return F.coalesce(rnd(f(v), 4).cast("string"), f(raw.cast("string")))
    if fn in ("sum", "mean"):
        return rnd((F.sum if fn == "sum" else F.avg)(v), 4)
    raise ValueError(f"unknown aggregate {fn!r}")


def grouped(df: DataFrame, keys: Mapping[str, Column], ys: Sequence[str], fn: str) -> DataFrame:
    """One aggregate of every y per key; the median goes through exact distributed quantiles."""
    named = df.withColumns(dict(keys))
    names = list(keys)
    if fn != "median":
        return named.groupBy(*names).agg(*[agg_column(df, y, fn).alias(y) for y in ys])
    q = quantiles(named, ys, [0.5], names)
    wide = q.groupBy(*names).agg(*[rnd(F.max(F.when(F.col("column") == y, F.col("q")[0])), 4).alias(y) for y in ys])
    return named.select(*names).distinct().join(wide, names, "left")

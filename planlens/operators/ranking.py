"""First / latest rows, ranks, paging and list orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dealt
from .ordered import framed, row_numbers, scan


def newest_key(order_by: Sequence[str]) -> Column:
    """Comparable struct, nulls lowest, for 'newest wins'."""
    return F.struct(*[x for c in order_by for x in (F.col(c).isNotNull().alias(f"n_{c}"), F.col(c).alias(c))])


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Newest row per key.  ``max_by`` combines before the shuffle, so a hot key stays cheap."""
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), newest_key(order_by)).alias("r")).select("r.*"))


def first_per(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row number 1 per key, ascending, nulls last."""
    order = F.struct(*[x for c in order_by for x in (F.col(c).isNull().alias(f"n_{c}"), F.col(c).alias(c))])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def numbered_per(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "rn") -> DataFrame:
    """Row number per key over any group size."""
    return row_numbers(df, order_by, keys, out)


def latest_import(df: DataFrame, import_id: str, created: str) -> DataFrame:
    """Rows of the newest import only."""
    newest = df.agg(F.max_by(import_id, F.struct(created, import_id)).alias("i")).scalar()
    return df.filter(F.col(import_id) == newest)


def latest_cumulative(df: DataFrame, period_facts: DataFrame, key: str, month: str = "month") -> DataFrame:
    """The newest cumulative slice of each period, else that period's plain facts.

    ``month`` is null on rows that come from the fallback.
    """
    last = df.groupBy(key).agg(F.max(month).alias("__last"))
    cols = [c for c in df.columns if c != month]
    slices = df.join(last, (df[month] == last["__last"]) & df[key].eqNullSafe(last[key]), "left_semi")
    fallback = period_facts.join(last, key, "left_anti").select(*cols, F.lit(None).cast("int").alias(month))
    return slices.select(*cols, F.col(month).cast("int").alias(month)).unionByName(fallback)


def avg_rank(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Average-tie rank of each distinct value: (by…, v, c, avg_rank)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = scan(counts, {"cum": ("sum", F.col("c"))}, ["v"], by)
    return ranked.select(*by, "v", "c", (F.col("cum") - F.col("c") + (F.col("c") + 1) / 2).alias("avg_rank"))


def with_avg_rank(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Every row with its average-tie rank; null values get no rank."""
    ranks = avg_rank(df, col, by).select(*by, F.col("v").alias(col), F.col("avg_rank").alias(out))
    return df.join(dealt(ranks), [*by, col], "left")


def rolling(df: DataFrame, col: str, window: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean and population std over ``window`` rows, null until the window is full."""
    def make(w):
        f = w.rowsBetween(-(window - 1), 0)
        full = F.count(F.col(col)).over(f) == window
        return {"rolling_mean": F.when(full, F.avg(col).over(f)), "rolling_std": F.when(full, F.stddev_pop(col).over(f))}
    return framed(df, make, window - 1, 0, order_by, partition_by)


def lag_pairs(df: DataFrame, col: str, k: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """(y[t-k], y[t]) pairs."""
    out = framed(df, lambda w: {"x": F.lag(col, k).over(w), "y": F.col(col)}, k, 0, order_by, partition_by)
    return out.filter("x IS NOT NULL AND y IS NOT NULL")


def page(df: DataFrame, sort: str | None, direction: str, limit: int, offset: int = 0, tie_break: Sequence[str] = ()) -> DataFrame:
    """One sorted page; nulls last either way.  ``tie_break`` makes pages stable."""
    keys = []
    if sort:
        c = F.col(f"`{sort}`")
        keys.append(c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_last())
    keys += [F.col(f"`{t}`").asc() for t in tie_break if t != sort]
    return (df.orderBy(*keys) if keys else df).offset(offset).limit(limit)


def rank_orgs(df: DataFrame, order: str = "desc", keep: str = "all", value: str = "fact_value", name: str = "organization_name") -> DataFrame:
    """Organizations by percent (``desc`` / ``asc`` / ``name``), nulls last, then name.

    ``keep``: all, performed (>= 100), not_performed (< 100); a null percent is in neither.
    """
    if keep == "performed":
        df = df.filter(F.col(value) >= 100)
    elif keep == "not_performed":
        df = df.filter(F.col(value) < 100)
    v = F.col(value)
    if order == "name":
        return df.orderBy(name)
    return df.orderBy(v.desc_nulls_last() if order == "desc" else v.asc_nulls_last(), F.col(name))


def type_priority(status: str, manual: str, problem: str) -> Column:
    return (F.when(F.col(problem), 0).when(F.col(manual), 1).when(F.col(status) == "required", 2)
            .when(F.col(status).isin("unknown", "missing"), 3).otherwise(4))


def rank_types(df: DataFrame, code: str, status: str = "requirement_status", manual: str = "is_manual", problem: str = "is_problem") -> DataFrame:
    """Problem, manual, required, unknown, rest; then by numeric code, then code."""
    return df.orderBy(type_priority(status, manual, problem), F.col(code).try_cast("double").asc_nulls_last(), F.col(code))


# fixed values: severity order of findings
SEVERITIES = ["error", "warning", "info"]


def severity_rank(c: str) -> Column:
    e = F.when(F.col(c) == SEVERITIES[0], 0)
    for i, s in enumerate(SEVERITIES[1:], 1):
        e = e.when(F.col(c) == s, i)
    return e.otherwise(len(SEVERITIES))


def list_findings(df: DataFrame, period: str, organization: str | None = None) -> DataFrame:
    """Active findings of a period by severity, type name (nulls first), creation time, id."""
    out = df.filter((F.col("period_id") == period) & F.col("is_active"))
    if organization is not None:
        out = out.filter(F.col("organization_oid") == organization)
    return out.orderBy(severity_rank("severity"), F.col("type_name").asc_nulls_first(), "created_at", "finding_id")


def systematic_sample(df: DataFrame, n: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Every k-th row, k = ceil(rows / n), starting with the first."""
    rows = scan(df, {"__rn": ("sum", F.lit(1).cast("long")), "__n": ("total", F.lit(1).cast("long"))}, order_by, partition_by)
    step = F.greatest(F.lit(1), F.ceil(F.col("__n") / n))
    return rows.filter((F.col("__rn") - 1) % step == 0).drop("__rn", "__n")

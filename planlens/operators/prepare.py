"""Config-driven preparation: impute, scale, encode, remove outliers.

Column statistics are attached as scalar subqueries (one aggregate per step), category tables by a
left join, so a step stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import collected_statistics, dealt, number, one_row, rnd, type_of
from ..session import can_cut
from .joins import lookup
from .ordered import known_neighbours, scan
from .quantiles import quantile_scalars

Config = Mapping[str, Mapping[str, Any]]


def _known(df: DataFrame, config: Config) -> dict[str, Mapping[str, Any]]:
    return {c: cfg for c, cfg in config.items() if c in df.columns}


def _order(order_by: Sequence[str] | None, method: str) -> Sequence[str]:
    if not order_by:
        raise ValueError(f"{method} needs order_by: a DataFrame has no row order")
    return order_by


# --- impute -----------------------------------------------------------------------------------

def constant_for(kind: T.DataType, raw: Any) -> Any:
    """A constant coerced to the column type; '' or a bad number is 0."""
    if isinstance(kind, T.NumericType):
        try:
            v = float(raw) if raw not in ("", None) else 0.0
        except (TypeError, ValueError):
            v = 0.0
        return int(v) if isinstance(kind, T.IntegralType) else v
    return "" if raw is None else str(raw)


def mode_scalar(df: DataFrame, col: str) -> Column:
    """Most frequent non-null value; ties go to the smallest."""
    freq = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    return one_row(freq.agg(F.min_by("v", F.struct((-F.col("c")).alias("c"), F.col("v").alias("v"))).alias("m"))).getField("m")


def fill_along(df: DataFrame, cols: Sequence[str], direction: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Forward or backward fill."""
    kind = "last" if direction == "ffill" else "first"
    names = df.columns
    out = scan(df, {f"__f_{c}": (kind, F.col(c)) for c in cols}, order_by, partition_by)
    return out.select(*[F.col(f"__f_{c}").alias(c) if c in cols else F.col(c) for c in names])


def interpolate(df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Linear by row position; ends stay null."""
    names = df.columns
    out = known_neighbours(df, {c: number(c) for c in cols}, order_by, partition_by)

    def filled(c: str) -> Column:
        lo, hi = F.col(f"__b1_{c}"), F.col(f"__a1_{c}")
        step = (hi["v"] - lo["v"]) / F.nullif(hi["i"] - lo["i"], F.lit(0))
        return F.coalesce(number(c), lo["v"] + step * (F.col("__pos") - lo["i"]))
    return out.select(*[filled(c).alias(c) if c in cols else F.col(c) for c in names])


def impute(df: DataFrame, config: Config, order_by: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """``{col: {method: mean|median|mode|constant|ffill|bfill|linear|drop, value}}``.

    An all-null column stays as it is; rows are dropped after the fills.
    """
    cfg = _known(df, config)
    by = lambda *m: [c for c, x in cfg.items() if x.get("method", "mean") in m]
    source = df
    fills: dict[str, Column] = {}
    means = by("mean")
    if means:
        row = one_row(source.agg(*[F.avg(number(c)).alias(c) for c in means]))
        fills |= {c: F.coalesce(F.col(c).try_cast("double"), row.getField(c)) for c in means}
    medians = by("median")
    if medians:
        q = quantile_scalars(source, medians, [0.5])
        fills |= {c: F.coalesce(F.col(c).try_cast("double"), q[c][0]) for c in medians}
    fills |= {c: F.coalesce(F.col(c), mode_scalar(source, c)) for c in by("mode")}
    fills |= {c: F.coalesce(F.col(c), F.lit(constant_for(type_of(df, c), cfg[c].get("value", ""))).cast(type_of(df, c))) for c in by("constant")}
    out = df
    for method in ("ffill", "bfill"):
        if by(method):
            out = fill_along(out, by(method), method, _order(order_by, method), partition_by)
    if by("linear"):
        out = interpolate(out, by("linear"), _order(order_by, "linear"), partition_by)
    if fills:
        out = out.withColumns(fills)
    return out.dropna("any", subset=by("drop")) if by("drop") else out


# --- scale ------------------------------------------------------------------------------------

def _nonzero(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(F.coalesce(c, F.lit(1.0)))


def scale(df: DataFrame, config: Config, ddof: int = 1) -> DataFrame:
    """``{col: {method: standard|center_only|unit_variance|minmax|minmax_sym|maxabs|robust|percentile, pLow, pHigh}}``.

    A zero spread counts as 1; an all-null column stays null.
    """
    cfg = _known(df, config)
    sd = F.stddev_samp if ddof else F.stddev_pop
    wanted = {"standard": ("mean", "sd"), "center_only": ("mean",), "unit_variance": ("sd",), "minmax": ("min", "max"),
              "minmax_sym": ("min", "max"), "maxabs": ("absmax",)}
    stat = {"mean": F.avg, "sd": sd, "min": F.min, "max": F.max, "absmax": lambda v: F.max(F.abs(v))}
    aggs = [stat[s](number(c)).alias(f"{s}_{c}") for c, x in cfg.items() for s in wanted.get(x.get("method", "standard"), ())]
    row = one_row(df.agg(*aggs)) if aggs else None
    probs = {c: [0.25, 0.5, 0.75] if x["method"] == "robust" else [x.get("pLow", 5) / 100, x.get("pHigh", 95) / 100]
             for c, x in cfg.items() if x.get("method") in ("robust", "percentile")}
    every = sorted({p for ps in probs.values() for p in ps})
    q = quantile_scalars(df, list(probs), every) if probs else {}
    out = {}
    for c, x in cfg.items():
        method, v = x.get("method", "standard"), F.col(c).try_cast("double")
        s = {k: row.getField(f"{k}_{c}") for k in wanted.get(method, ())}
        if method == "standard":
            out[c] = (v - s["mean"]) / _nonzero(s["sd"])
        elif method == "center_only":
            out[c] = v - s["mean"]
        elif method == "unit_variance":
            out[c] = v / _nonzero(s["sd"])
        elif method == "minmax":
            out[c] = (v - s["min"]) / _nonzero(s["max"] - s["min"])
        elif method == "minmax_sym":
            out[c] = 2 * (v - s["min"]) / _nonzero(s["max"] - s["min"]) - 1
        elif method == "maxabs":
            out[c] = v / _nonzero(s["absmax"])
        elif method == "robust":
            lo, mid, hi = (q[c][every.index(p)] for p in probs[c])
            out[c] = (v - mid) / _nonzero(hi - lo)
        elif method == "percentile":
            lo, hi = (q[c][every.index(p)] for p in probs[c])
            out[c] = F.when(v.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - lo) / _nonzero(hi - lo))))
        else:
            raise ValueError(f"unknown scale method {method!r}")
    return df.withColumns(out) if out else df


# --- encode -----------------------------------------------------------------------------------

def _replace(df: DataFrame, col: str, value: Column, *drop: str) -> DataFrame:
    names = [c for c in df.columns if c not in drop]
    return df.select(*[value.alias(col) if c == col else F.col(c) for c in names])


def encode_label(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values (case-insensitive) to 0..k-1, null to k."""
    cats = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("__c")).distinct().withColumn("__l", F.lower("__c"))
    codes = scan(cats, {"__code": ("sum", F.lit(1).cast("long"))}, ["__l", "__c"]).select(F.col("__c"), (F.col("__code") - 1).alias("__code"))
    k = one_row(cats.agg(F.count(F.lit(1)).alias("k"))).getField("k")
    out = lookup(df.withColumn("__c", F.col(col).cast("string")), codes, "__c")
    return _replace(out.select(*df.columns, "__code"), col, F.coalesce("__code", k), "__code")


def encode_ordinal(df: DataFrame, col: str, order: Sequence[str] | None) -> DataFrame:
    """Position in the given order, k for null and unlisted; without an order as label encoding."""
    if not order:
        return encode_label(df, col)
    codes = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(str(v)), F.lit(i).cast("long"))])
    return df.withColumn(col, F.coalesce(F.try_element_at(codes, F.col(col).cast("string")), F.lit(len(order)).cast("long")))


def encode_count(df: DataFrame, col: str, share: bool = False) -> DataFrame:
    """How often the category occurs, or its share rounded to 8 digits; null stays null."""
    text = df.withColumn(col, F.col(col).cast("string"))
    counts = text.groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    if share:
        total = one_row(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
        counts = counts.withColumn("__n", rnd(F.col("__n") / total, 8))
    out = lookup(text, counts, col)
    return _replace(out.select(*df.columns, "__n"), col, F.col("__n"), "__n")


def encode_onehot(df: DataFrame, col: str, max_categories: int = 1_000, keep_source: bool = False) -> DataFrame:
    """``col__value`` columns of 0/1 in sorted order; null is 0 everywhere.  Too many categories is an error."""
    seen = df.select(F.col(col).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(max_categories + 1).collect()
    if len(seen) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories")
    text = F.coalesce(F.col(col).cast("string"), F.lit(None).cast("string"))
    flags = [F.when(text == v, 1).otherwise(0).cast("byte").alias(f"{col}__{v}") for v in sorted(r["v"] for r in seen)]
    return df.select(*[c for c in df.columns if keep_source or c != col], *flags)


def encode_target(df: DataFrame, col: str, target: str, leave_one_out: bool = False) -> DataFrame:
    """Target mean per category, 8 digits; null or (leave-one-out) single categories get the global mean."""
    t = number(target)
    whole = one_row(df.agg(F.avg(t).alias("m"))).getField("m")
    sums = df.groupBy(F.col(col).alias("__k")).agg(F.sum(t).alias("__s"), F.count(t).alias("__n"))
    out = df.join(dealt(sums), F.col(col) == F.col("__k"), "left")
    s, n = F.col("__s"), F.col("__n")
    if leave_one_out:
        value = F.when(n > 1, rnd((s - t) / F.nullif(n - 1, F.lit(0)), 8)).otherwise(whole)
    else:
        value = F.coalesce(rnd(s / F.nullif(n, F.lit(0)), 8), whole)
    return _replace(out, col, value, "__k", "__s", "__n")


def encode_woe(df: DataFrame, col: str, target: str) -> DataFrame:
    """Weight of evidence of a 0/1 target with a floor of 0.5; unchanged unless both classes exist."""
    t = number(target)
    ones, zeros = F.count_if(t == 1), F.count_if(t == 0)
    totals = df.agg(ones.alias("e"), zeros.alias("z")).head()
    if not totals["e"] or not totals["z"]:
        return df
    table = df.groupBy(F.col(col).alias("__k")).agg(ones.alias("__e"), zeros.alias("__z"))
    ratio = (F.greatest(F.col("__e"), F.lit(0.5)) / totals["e"]) / (F.greatest(F.col("__z"), F.lit(0.5)) / totals["z"])
    out = df.join(dealt(table.select("__k", rnd(F.ln(ratio), 8).alias("__w"))), F.col(col) == F.col("__k"), "left")
    return _replace(out, col, F.col("__w"), "__k", "__w")


def encode(df: DataFrame, config: Config) -> DataFrame:
    """``{col: {method: label|ordinal|frequency|count|onehot|target|loo|woe, ordinalOrder, targetField}}`` in config order."""
    for col, x in _known(df, config).items():
        method, target = x.get("method", "label"), x.get("targetField")
        if method in ("target", "loo", "woe") and target not in df.columns:
            continue
        if method == "label":
            df = encode_label(df, col)
        elif method == "ordinal":
            df = encode_ordinal(df, col, x.get("ordinalOrder"))
        elif method in ("frequency", "count"):
            df = encode_count(df, col, share=method == "frequency")
        elif method == "onehot":
            df = encode_onehot(df, col, x.get("maxCategories", 1_000))
        elif method in ("target", "loo"):
            df = encode_target(df, col, target, method == "loo")
        elif method == "woe":
            df = encode_woe(df, col, target)
        else:
            raise ValueError(f"unknown encode method {method!r}")
    return df


# --- outliers ---------------------------------------------------------------------------------

MAD_FACTOR = 0.6745  # fixed value


def outlier_bounds(df: DataFrame, config: Config, ddof: int = 1) -> dict[str, tuple[Column, Column]]:
    """(lower, upper) scalar columns for ``iqr zscore robust_zscore percentile``, all from the input table."""
    cfg = _known(df, config)
    sd = F.stddev_samp if ddof else F.stddev_pop
    z = [c for c, x in cfg.items() if x.get("method", "iqr") == "zscore"]
    row = one_row(df.agg(*[e for c in z for e in (F.avg(number(c)).alias(f"m_{c}"), sd(number(c)).alias(f"s_{c}"))])) if z else None
    probs = {c: {"iqr": [.25, .75], "robust_zscore": [.5], "percentile": [x.get("pLow", 1) / 100, x.get("pHigh", 99) / 100]}[x.get("method", "iqr")]
             for c, x in cfg.items() if x.get("method", "iqr") != "zscore"}
    every = sorted({p for ps in probs.values() for p in ps})
    q = quantile_scalars(df, list(probs), every) if probs else {}
    robust = [c for c, x in cfg.items() if x.get("method") == "robust_zscore"]
    mads = {}
    if robust:
        dev = df.select(*[F.abs(number(c) - q[c][every.index(.5)]).alias(c) for c in robust])
        mads = {c: v[0] for c, v in quantile_scalars(dev, robust, [.5]).items()}
    out = {}
    for c, x in cfg.items():
        method = x.get("method", "iqr")
        if method == "zscore":
            half, mid = x.get("zThreshold", 3) * _nonzero(row.getField(f"s_{c}")), row.getField(f"m_{c}")
            out[c] = (mid - half, mid + half)
        elif method == "robust_zscore":
            mid = q[c][every.index(.5)]
            half = x.get("zThreshold", 3.5) * _nonzero(mads[c]) / MAD_FACTOR
            out[c] = (mid - half, mid + half)
        else:
            lo, hi = (q[c][every.index(p)] for p in probs[c])
            reach = x.get("iqrK", 1.5) * (hi - lo) if method == "iqr" else F.lit(0.0)
            out[c] = (lo - reach, hi + reach)
    return out


def remove_outliers(df: DataFrame, config: Config, ddof: int = 1) -> DataFrame:
    """Keep rows inside every column's bounds; null is inside, so is a column without bounds."""
    for c, (lo, hi) in outlier_bounds(df, config, ddof).items():
        v = number(c)
        df = df.filter(v.isNull() | lo.isNull() | ((v >= lo) & (v <= hi)))
    return df


def preview_outliers(df: DataFrame, config: Config, ddof: int = 0) -> DataFrame:
    """(column, total, outliers, lower, upper) without removing anything."""
    bounds = outlier_bounds(df, config, ddof)
    staged = df.select(*[number(c).alias(c) for c in bounds], *[e for c, (lo, hi) in bounds.items() for e in (lo.alias(f"__lo_{c}"), hi.alias(f"__hi_{c}"))])
    row = staged.agg(*[e for c in bounds for e in (
        F.count(c).alias(f"n_{c}"), F.count_if((F.col(c) < F.col(f"__lo_{c}")) | (F.col(c) > F.col(f"__hi_{c}"))).alias(f"o_{c}"),
        F.first(f"__lo_{c}").alias(f"l_{c}"), F.first(f"__hi_{c}").alias(f"h_{c}"))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("total"), F.col(f"o_{c}").alias("outliers"),
                                                  F.col(f"l_{c}").alias("lower"), F.col(f"h_{c}").alias("upper")) for c in bounds])))


# --- steps ------------------------------------------------------------------------------------

TWICE = {"ffill", "bfill", "linear", "polynomial_fill", "spline_fill", "ewm", "rolling_mean", "rolling_mean_fill", "rolling_median",
         "diff", "seasonal_diff", "lag_feature"}  # ordered methods read their input for numbering and for values


def reads_twice(step: Mapping[str, Any]) -> bool:
    """Whether a step's plan contains its input more than once (a category table, an ordered scan)."""
    cfg = step.get("config", {})
    if step["type"] == "encode":
        return any(x.get("method", "label") not in ("onehot", "ordinal") for x in cfg.values())
    if step["type"] == "impute":
        return any(x.get("method") in TWICE for x in cfg.values())
    return step["type"] == "timeseries" and cfg.get("method") in TWICE


def run_steps(
    df: DataFrame, steps: Sequence[Mapping[str, Any]], order_by: Sequence[str] | None = None, partition_by: Sequence[str] = (),
    cut_every: int = 2,
) -> DataFrame:
    """Apply ``[{type, config}]`` in order; unknown types are skipped.

    Statistics of a step are computed when it is added.  After ``cut_every`` steps that contain their
    input twice the result is checkpointed, if the session names a checkpoint folder, so a long chain
    does not repeat its beginning.
    """
    from .series import timeseries, window_split
    ops = {
        "impute": lambda d, c: impute(d, c, order_by, partition_by), "scale": scale, "encode": encode, "outliers": remove_outliers,
        "timeseries": lambda d, c: timeseries(d, c, order_by, partition_by),
        "window_split": lambda d, c: window_split(d, c["field"], c.get("unit", "year"))}
    pending = 0
    with collected_statistics():
        for step in steps:
            if step["type"] not in ops:
                continue
            if pending >= cut_every and can_cut(df):
                df, pending = df.checkpoint(), 0
            df = ops[step["type"]](df, step.get("config", {}))
            pending += reads_twice(step)
    return df

"""Time-series preparation and analysis.  ``order_by`` ends in a unique key; many series run at once
through ``partition_by``, and one long series is still spread over many tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number
from ..functions.parse import iso_week
from .ordered import BLOCK_ROWS, ROW, framed, known_neighbours, row_numbers, scan
from .prepare import fill_along, impute, interpolate, scale
from .quantiles import ranked_counts
from .spectrum import power_spectrum

EWM_MIN_ALPHA = 0.001  # fixed value: smallest smoothing factor


def centred_frame(window: int) -> tuple[int, int]:
    """Rows before and after; even windows look one further back."""
    half = window // 2
    return half, window - 1 - half


def _own(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(values))


def timeseries(df: DataFrame, config: Mapping[str, Any], order_by: Sequence[str] | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """``{method, fields, window, alpha, lambda}``; results replace the fields, ``lag_feature`` adds ``field_lagK``."""
    method, fields = config["method"], [f for f in config.get("fields", []) if f in df.columns]
    if not fields:
        return df
    w = int(config.get("window", 3))
    df = _own(df, {f: number(f) for f in fields})
    if method in ("mean_fill", "median_fill"):
        return impute(df, {f: {"method": method[:-5]} for f in fields})
    if method == "normalize":
        return scale(df, {f: {"method": "minmax"} for f in fields})
    if method == "standardize":
        return scale(df, {f: {"method": "standard"} for f in fields}, ddof=int(config.get("ddof", 1)))
    if method == "log_transform":
        return _own(df, {f: F.when(F.col(f) > 0, F.ln(f)) for f in fields})
    if method == "boxcox":
        lam = float(config.get("lambda", 0.5))
        e = (lambda c: F.ln(c)) if abs(lam) < 1e-6 else (lambda c: (F.pow(c, F.lit(lam)) - 1) / lam)
        return _own(df, {f: F.when(F.col(f) > 0, e(F.col(f))) for f in fields})
    if not order_by:
        raise ValueError(f"{method} needs order_by: a DataFrame has no row order")
    if method in ("ffill", "bfill"):
        return fill_along(df, fields, method, order_by, partition_by)
    if method == "linear":
        return interpolate(df, fields, order_by, partition_by)
    if method in ("polynomial_fill", "spline_fill"):
        return neighbour_fill(df, fields, method, order_by, partition_by)
    if method == "ewm":
        for f in fields:
            df = ewm(df, f, float(config.get("alpha", 0.3)), order_by, partition_by)
        return df
    before, after = centred_frame(w)
    if method in ("rolling_mean", "rolling_mean_fill", "rolling_median"):
        def make(win: Window) -> dict[str, Column]:
            over = win.rowsBetween(-before, after)
            out = {}
            for f in fields:
                e = (F.percentile(f, F.lit(0.5)) if method == "rolling_median" else F.avg(f)).over(over)
                out[f"__w_{f}"] = F.coalesce(F.col(f), e) if method == "rolling_mean_fill" else e
            return out
        names = df.columns
        res = framed(df, make, before, after, order_by, partition_by)
        return res.select(*[F.col(f"__w_{c}").alias(c) if c in fields else F.col(c) for c in names])
    if method in ("diff", "seasonal_diff", "lag_feature"):
        names = df.columns
        res = framed(df, lambda win: {f"__g_{f}": F.lag(f, w).over(win) for f in fields}, w, 0, order_by, partition_by)
        if method == "lag_feature":
            return res.select(*names, *[F.col(f"__g_{f}").alias(f"{f}_lag{w}") for f in fields])
        return res.select(*[(F.col(c) - F.col(f"__g_{c}")).alias(c) if c in fields else F.col(c) for c in names])
    raise ValueError(f"unknown timeseries method {method!r}")


def neighbour_fill(df: DataFrame, fields: Sequence[str], method: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill gaps from the two known points on each side.

    ``polynomial_fill``: parabola through two points before and one after (a line when there is only
    one before).  ``spline_fill``: Catmull-Rom through two before and two after, missing outer points
    mirrored.  Ends stay null.
    """
    names = df.columns
    far = known_neighbours(df, {f: F.col(f) for f in fields}, order_by, partition_by)

    def filled(f: str) -> Column:
        x = F.col("__pos").cast("double")
        p0, p1, p2, p3 = (F.col(f"__{k}_{f}") for k in ("b2", "b1", "a1", "a2"))
        x1, y1, x2, y2 = p1["i"], p1["v"], p2["i"], p2["v"]
        line = y1 + (y2 - y1) * (x - x1) / (x2 - x1)
        if method == "polynomial_fill":
            a, ya = p0["i"], p0["v"]
            e = (ya * ((x - x1) * (x - x2)) / ((a - x1) * (a - x2)) + y1 * ((x - a) * (x - x2)) / ((x1 - a) * (x1 - x2))
                 + y2 * ((x - a) * (x - x1)) / ((x2 - a) * (x2 - x1)))
            e = F.when(p0.isNotNull(), e).otherwise(line)
        else:
            y0, y3 = F.coalesce(p0["v"], 2 * y1 - y2), F.coalesce(p3["v"], 2 * y2 - y1)
            t = (x - x1) / (x2 - x1)
            e = 0.5 * (2 * y1 + (y2 - y0) * t + (2 * y0 - 5 * y1 + 4 * y2 - y3) * t * t + (3 * y1 - y0 - 3 * y2 + y3) * t * t * t)
        return F.coalesce(F.col(f), F.when(p1.isNotNull() & p2.isNotNull(), e))
    return far.select(*[filled(c).alias(c) if c in fields else F.col(c) for c in names])


def ewm(df: DataFrame, col: str, alpha: float, order_by: Sequence[str], partition_by: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """Exponentially weighted mean, y = a x + (1 - a) y; null rows are skipped and stay null.

    Blocks of rows carry enough earlier rows that what lies before them weighs less than a double can
    hold, so blocks are independent and the result does not depend on how the table is split.
    """
    a = max(EWM_MIN_ALPHA, min(1.0, alpha))
    reach = 1 if a == 1 else math.ceil(math.log(1e-18) / math.log(1 - a))
    size = max(block_rows or BLOCK_ROWS, reach)
    rows = row_numbers(df.filter(F.col(col).isNotNull()), order_by, partition_by)
    home, pos = F.floor((F.col(ROW) - 1) / size), (F.col(ROW) - 1) % size
    spread = rows.withColumn("__home", home).withColumn(
        "__blk", F.explode(F.array_compact(F.array("__home", F.when(pos >= size - reach, F.col("__home") + 1)))))
    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == col else f.dataType, True) for f in df.schema.fields])

    def smooth(table: pa.Table) -> pa.Table:
        t = table.sort_by(ROW)
        y = pd.Series(t.column(col).to_numpy()).ewm(alpha=a, adjust=False).mean().to_numpy()
        own = t.column("__home").to_numpy() == t.column("__blk").to_numpy()
        t = t.set_column(t.column_names.index(col), col, pa.array(y, pa.float64())).filter(pa.array(own))
        return t.select(names)
    known = spread.groupBy(*partition_by, "__blk").applyInArrow(smooth, schema)
    return known.unionByName(df.filter(F.col(col).isNull()).select(*[F.col(c).cast("double") if c == col else F.col(c) for c in names]))


UNITS = {"year": lambda d: F.year(d), "yearmonth": lambda d: F.date_format(d, "yyyy-MM"), "yearweek": iso_week,
         "day": lambda d: F.date_format(d, "yyyy-MM-dd"), "hour": lambda d: F.hour(d), "hourminute": lambda d: F.date_format(d, "HH:mm"),
         "second": lambda d: F.date_format(d, "HH:mm:ss")}


def window_split(df: DataFrame, field: str, unit: str = "year") -> DataFrame:
    """Add ``field_unit``; text that is no timestamp gives null."""
    if field not in df.columns or unit not in UNITS:
        return df
    c = F.col(field)
    if isinstance(df.schema[field].dataType, T.StringType):
        c = c.try_cast("timestamp_ntz")
    return df.withColumn(f"{field}_{unit}", UNITS[unit](c))


# --- analysis ---------------------------------------------------------------------------------

def base_series(df: DataFrame, x: str, y: str | None, order_by: Sequence[str]) -> DataFrame:
    """(x, y) sorted by time with finite y, or the row count per x when ``y`` is None."""
    if y is None:
        return df.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("y")).orderBy("x")
    return df.select(F.col(x).alias("x"), number(y).alias("y"), *[c for c in order_by if c not in (x, y)]).filter("y IS NOT NULL").orderBy(
        *["x" if c == x else c for c in order_by])


def _numbered(df: DataFrame, y: str, order_by: Sequence[str], partition_by: Sequence[str]) -> DataFrame:
    """Finite rows with their number, the series length and the series mean, from one scan."""
    one = F.lit(1).cast("long")
    rows = df.withColumn("__y", number(y)).filter("__y IS NOT NULL")
    s = scan(rows, {ROW: ("sum", one), "__n": ("total", one), "__s": ("total", F.col("__y"))}, order_by, partition_by)
    return s.withColumn("__mean", F.col("__s") / F.col("__n")).drop("__s")


def acf(df: DataFrame, y: str, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """(partition…, lag, acf, band): lags 0..min(max_lag, n / 2), band 1.96 / sqrt(n)."""
    rows = _numbered(df, y, order_by, partition_by).withColumn("__d", F.col("__y") - F.col("__mean"))
    lags = framed(rows, lambda w: {f"__l{k}": F.lag("__d", k).over(w) for k in range(1, max_lag + 1)}, max_lag, 0, [ROW], partition_by)
    sums = lags.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("s0"),
                                           *[F.sum(F.col("__d") * F.col(f"__l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)])
    if not partition_by:
        sums = sums.filter("n > 0")
    value = lambda k: F.when(F.col("s0") == 0, 0.0).otherwise(F.col(f"s{k}") / F.nullif(F.col("s0"), F.lit(0.0)))
    points = F.array(*[F.struct(F.lit(k).alias("lag"), value(k).alias("acf")) for k in range(max_lag + 1)])
    return (sums.select(*partition_by, "n", F.inline(points)).filter(F.col("lag") <= F.floor(F.col("n") / 2))
            .select(*partition_by, "lag", "acf", (1.96 / F.sqrt("n")).alias("band")))


def durbin_levinson(r: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations r[0..L]."""
    out, phi = [1.0], np.zeros(0)
    r = np.asarray(r, dtype=float)
    for k in range(1, len(r)):
        den = 1 - float(phi @ r[1:k]) if k > 1 else 1.0
        last = 0.0 if den == 0 else (r[k] - (float(phi @ r[k - 1:0:-1]) if k > 1 else 0.0)) / den
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _pacf(r: pd.Series) -> pd.Series:
    return r.map(durbin_levinson)


def pacf(df: DataFrame, y: str, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """(partition…, lag, pacf, band): Durbin-Levinson on the lag vector of each series, max_lag numbers long."""
    a = acf(df, y, max_lag, order_by, partition_by)
    vec = a.groupBy(*partition_by).agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("v"), F.first("band").alias("band"))
    if not partition_by:
        vec = vec.filter(F.size("v") > 0)
    return vec.select(*partition_by, F.posexplode(_pacf(F.col("v.acf"))).alias("lag", "pacf"), "band")


def decompose(df: DataFrame, y: str, period: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Adds trend (centred moving average), seasonal (mean per phase) and residual; null at both ends."""
    period = max(2, period)
    h = period // 2
    rows = _numbered(df, y, order_by, partition_by)
    inside = (F.col(ROW) > h) & (F.col(ROW) <= F.col("__n") - h)
    t = framed(rows, lambda w: {"trend": F.when(inside, F.avg("__y").over(w.rowsBetween(-h, h)))}, h, h, [ROW], partition_by, keep_row=True)
    t = t.withColumn("__phase", (F.col(ROW) - 1) % period)
    phases = t.groupBy(*partition_by, "__phase").agg(F.coalesce(F.avg(F.col("__y") - F.col("trend")), F.lit(0.0)).alias("__sea"))
    j = t.join(phases, [*partition_by, "__phase"], "left").withColumn("seasonal", F.when(F.col("trend").isNotNull(), F.col("__sea")))
    return j.select(*df.columns, "trend", "seasonal", (F.col("__y") - F.col("trend") - F.col("seasonal")).alias("residual"))


def rolling_band(df: DataFrame, y: str, window: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean with mean ± population std; null until the window is full."""
    def make(w: Window) -> dict[str, Column]:
        f = w.rowsBetween(-(window - 1), 0)
        full = F.count("__y").over(f) == window
        return {"rm": F.when(full, F.avg("__y").over(f)), "rstd": F.when(full, F.stddev_pop("__y").over(f))}
    rows = df.withColumn("__y", number(y)).filter("__y IS NOT NULL")
    out = framed(rows, make, window - 1, 0, order_by, partition_by)
    return out.select(*df.columns, "rm", "rstd", (F.col("rm") + F.col("rstd")).alias("upper"), (F.col("rm") - F.col("rstd")).alias("lower"))


def stationarity(df: DataFrame, y: str, window: int, max_lag: int, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rolling table, acf table)."""
    return rolling_band(df, y, window, order_by, partition_by), acf(df, y, max_lag, order_by, partition_by)


def periodogram(df: DataFrame, y: str, order_by: Sequence[str], first_k: int = 1, last_k: int | None = None) -> DataFrame:
    """(k, freq, period, power) for k = first_k..n / 2, or up to ``last_k`` if that is smaller.

    A fast transform over the cluster, in n log n work for any n.
    """
    rows = _numbered(df, y, order_by, ()).select((F.col(ROW) - 1).alias("i"), (F.col("__y") - F.col("__mean")).alias("d"), F.col("__n").alias("n"))
    end = F.floor(F.col("n") / 2)
    end = end if last_k is None else F.least(end, F.lit(last_k))
    found = power_spectrum(rows).filter((F.col("k") >= first_k) & (F.col("k") <= end))
    return found.select(F.col("k").cast("int").alias("k"), (F.col("k") / F.col("n")).alias("freq"), (F.col("n") / F.col("k")).alias("period"), "power")


def top_periods(spectrum: DataFrame, n: int = 3) -> DataFrame:
    return spectrum.orderBy(F.desc("power"), "k").limit(n)


def seasonal_key(x: str, by: str) -> Column:
    return {"month": F.month(x), "weekday": F.dayofweek(x), "year": F.year(x)}[by]


def seasonal_box(df: DataFrame, x: str, y: str, by: str = "month") -> DataFrame:
    """(group, q1, median, q3, min, max, mean) per month or weekday; quartiles are the values at index floor(n p)."""
    rows = df.select(seasonal_key(x, by).alias("group"), number(y).alias("v")).filter("v IS NOT NULL AND group IS NOT NULL")
    counts = rows.groupBy("group", F.lit("y").alias("column"), "v").agg(F.count(F.lit(1)).alias("c"))
    at = lambda p: F.min(F.when(F.col("cum") > F.floor(F.col("n") * p), F.col("v")))
    return ranked_counts(counts, ["group"]).groupBy("group").agg(
        at(.25).alias("q1"), at(.5).alias("median"), at(.75).alias("q3"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def seasonal_overlay(df: DataFrame, x: str, y: str, by: str, order_by: Sequence[str], series: int | None = None) -> DataFrame:
    """(key, i, y): position within each year or weekday, of all keys or the first ``series``."""
    rows = df.select(seasonal_key(x, by).alias("key"), number(y).alias("y"), *order_by).filter("y IS NOT NULL AND key IS NOT NULL")
    if series is not None:
        rows = rows.join(rows.select("key").distinct().orderBy("key").limit(series), "key", "left_semi")
    return row_numbers(rows, order_by, ["key"], "i").select("key", "i", "y")


def calendar_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(date, value, n): mean value per day."""
    return (df.select(F.to_date(x).alias("date"), number(y).alias("v")).filter("date IS NOT NULL AND v IS NOT NULL")
            .groupBy("date").agg(F.avg("v").alias("value"), F.count("v").alias("n")))


def day_hour(df: DataFrame, x: str, y: str) -> DataFrame:
    """(day 0 = Sunday, hour, value, n)."""
    return (df.select((F.dayofweek(x) - 1).alias("day"), F.hour(x).alias("hour"), number(y).alias("v")).filter("day IS NOT NULL AND v IS NOT NULL")
            .groupBy("day", "hour").agg(F.avg("v").alias("value"), F.count("v").alias("n")))


def series_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) over rows where both series have a value; 0 when one is constant."""
    from .association import pearson_matrix
    return pearson_matrix(df, cols).select("col_a", "col_b", F.coalesce("r", F.lit(0.0)).alias("r"))


def series_points(df: DataFrame, x: str, cols: Sequence[str]) -> DataFrame:
    """(x, cols…) with at least one finite value."""
    return df.select(x, *[number(c).alias(c) for c in cols]).dropna("all", subset=list(cols))


def series_scatter(df: DataFrame, a: str, b: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, number(a).alias("x"), number(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")

"""Chart-ready tables.  Each returns the rows a chart draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded_values, dealt, label, number, one_row, rnd
from .aggregate import grouped
from .ordered import scan
from .quantiles import quantiles

MAX_LABELS = 10_000  # dense outputs are the product of two label sets: refuse, never cut


def chart_aggregate(df: DataFrame, x: str, ys: Sequence[str], fn: str) -> DataFrame:
    """(_x, ys…); ``none`` keeps the rows with numeric ys."""
    if fn == "none":
        return df.select(F.coalesce(F.col(x).cast("string"), F.lit("")).alias("_x"), *[number(y).alias(y) for y in ys])
    return grouped(df, {"_x": label(x)}, ys, fn)


def row_total(ys: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for y in ys:
        total = total + F.coalesce(number(y), F.lit(0.0))
    return total


def sort_chart(df: DataFrame, sort: str, ys: Sequence[str]) -> DataFrame:
    """``none name_asc value_asc value_desc``; value is the sum of the ys, ties by name."""
    if sort == "none":
        return df
    if sort == "name_asc":
        return df.orderBy("_x")
    t = row_total(ys)
    return df.orderBy(t.asc() if sort == "value_asc" else t.desc(), "_x")


def xy_chart(df: DataFrame, x: str, ys: Sequence[str], fn: str, sort: str = "none") -> DataFrame:
    return sort_chart(chart_aggregate(df, x, ys, fn), sort, ys)


table_widget = xy_chart


def stacked_pct(df: DataFrame, x: str, ys: Sequence[str], fn: str) -> DataFrame:
    """Each y as a share of its row's total, one digit; 0 when the total is 0."""
    base = chart_aggregate(df, x, ys, fn)
    total = row_total(ys)
    return base.select("_x", *[F.when(total == 0, 0.0).otherwise(
        rnd(F.coalesce(number(y), F.lit(0.0)) * 1000 / F.nullif(total, F.lit(0.0))) / 10).alias(y) for y in ys])


def part_of_whole(df: DataFrame, name: str, value: str, fn: str) -> DataFrame:
    """(name, value) descending, for pie, radial bar, funnel and treemap."""
    out = grouped(df, {"name": label(name)}, [value], "count" if fn == "none" else fn)
    return out.select("name", F.coalesce(F.col(value), F.lit(0)).alias("value")).orderBy(F.desc("value"), "name")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """(bin, lo, hi, count); a single value gives one bin."""
    v = df.select(number(col).alias("v")).filter("v IS NOT NULL")
    lim = one_row(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))
    located = v.withColumns({"lo": lim.getField("lo"), "w": (lim.getField("hi") - lim.getField("lo")) / bins})
    b = F.when(F.col("w") == 0, 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0)))))
    counts = located.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
             .withColumns({"lo0": lim.getField("lo"), "w": (lim.getField("hi") - lim.getField("lo")) / bins})
             .filter("w > 0 OR (w = 0 AND bin = 0)"))
    return every.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo0") + F.col("bin") * F.col("w")).alias("lo"),
        (F.col("lo0") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))


def heatmap(df: DataFrame, x: str, y: str, value: str, fn: str, dense: bool = True, max_labels: int = MAX_LABELS) -> DataFrame:
    """(x, y, value, min, max).  Dense fills missing cells with 0 and needs few labels; sparse has no limit."""
    named = df.withColumns({"__x": label(x), "__y": label(y)})
    cells = grouped(named, {"__x": F.col("__x"), "__y": F.col("__y")}, [value], "count" if fn == "none" else fn)
    cells = cells.select(F.col("__x").alias("x"), F.col("__y").alias("y"), F.coalesce(F.col(value), F.lit(0)).alias("value"))
    if dense:
        xs = named.select(F.col("__x").alias("x")).distinct()
        full = xs.withColumn("y", F.explode(bounded_values(named, "__y", max_labels)))
        cells = full.join(cells, ["x", "y"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    lim = one_row(cells.agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    return cells.withColumns({"min": lim.getField("lo"), "max": lim.getField("hi")})


def waterfall(df: DataFrame, x: str, y: str, fn: str, order: str | None = None) -> DataFrame:
    """(_x, base, delta, is_positive, total) in group order: by the label, or by the smallest ``order`` of a group, then the label."""
    g = grouped(df, {"_x": label(x)}, [y], "sum" if fn == "none" else fn)
    g = g.select("_x", F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("d"))
    if order is not None:
        g = g.join(df.groupBy(label(x).alias("_x")).agg(F.min(order).alias("__order")), "_x")
    s = scan(g, {"run": ("sum", F.col("d"))}, ["_x"] if order is None else ["__order", "_x"])
    base = F.when(F.col("d") >= 0, F.col("run") - F.col("d")).otherwise(F.col("run"))
    return s.select("_x", rnd(base, 4).alias("base"), rnd(F.abs("d"), 4).alias("delta"),
                    (F.col("d") >= 0).alias("is_positive"), rnd("run", 4).alias("total"))


def boxplot_by(df: DataFrame, x: str, y: str, empty: str | None = None) -> DataFrame:
    """(_x, min, q1, median, q3, max): linear quartiles, whiskers at the last value inside 1.5 IQR."""
    named = df.select(label(x).alias("_x") if empty is None else label(x, empty).alias("_x"), number(y).alias("v")).filter("v IS NOT NULL")
    q = quantiles(named, ["v"], [0.25, 0.5, 0.75], ["_x"]).select(
        "_x", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = named.join(dealt(q), "_x").groupBy("_x").agg(
        F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("min"),
        F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("max"))
    return q.join(ends, "_x").select("_x", "min", "q1", "median", "q3", "max")


def pareto(df: DataFrame, x: str, y: str, fn: str) -> DataFrame:
    """(_x, y, cum_pct) by value descending, ties by name."""
    g = grouped(df, {"_x": label(x)}, [y], "sum" if fn == "none" else fn)
    g = g.withColumn("__v", F.coalesce(F.col(y).cast("double"), F.lit(0.0)))
    s = scan(g, {"cum": ("sum", F.col("__v")), "tot": ("total", F.col("__v"))}, ["-__v", "_x"])
    return s.select("_x", y, F.when(F.col("tot") > 0, rnd(F.col("cum") / F.nullif(F.col("tot"), F.lit(0.0)) * 1000) / 10)
                    .otherwise(0.0).alias("cum_pct"))


def sankey(df: DataFrame, source: str, target: str, value: str | None, fn: str) -> DataFrame:
    """(source, target, value): self-links dropped, negative and zero links dropped."""
    keys = {"source": label(source), "target": label(target)}
    if value is None:
        out = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("value"))
    else:
        out = grouped(df, keys, [value], "sum" if fn == "none" else fn).withColumnRenamed(value, "value")
    return out.filter("source <> target AND value > 0")


def calendar(df: DataFrame, date: str, value: str, fn: str) -> DataFrame:
    """(day, value) for every day of the year with most days; days without data are null."""
    days = df.withColumn("day", F.col(date).try_cast("date")).filter("day IS NOT NULL")
    per_day = grouped(days, {"day": F.col("day")}, [value], "sum" if fn == "none" else fn)
    years = days.select("day").distinct().groupBy(F.year("day").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    year = years.agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y")).select(
        F.explode(F.sequence(F.make_date("y", F.lit(1), F.lit(1)), F.make_date("y", F.lit(12), F.lit(31)))).alias("day"))
    return year.join(per_day, "day", "left").select("day", F.col(value).alias("value"))


def kpi(df: DataFrame, y: str, fn: str, group: str | None = None) -> DataFrame:
    """One row (value, prev_value, change, group_label, prev_label); last group against the one before."""
    v = df.filter(number(y).isNotNull())
    if group is None:
        return grouped(v, {"g": F.lit("all")}, [y], fn).select(F.col(y).alias("value"))
    last_two = grouped(v, {"g": label(group)}, [y], fn).orderBy(F.desc("g")).limit(2)
    pair = last_two.agg(F.max("g").alias("hi"), F.min("g").alias("lo"), F.max_by(y, "g").alias("value"), F.min_by(y, "g").alias("prev"))
    has = F.col("hi") != F.col("lo")
    return pair.select("value", F.when(has, F.col("prev")).alias("prev_value"),
                       F.when(has & (F.col("prev") != 0), (F.col("value") - F.col("prev")) / F.nullif(F.abs("prev"), F.lit(0)) * 100).alias("change"),
                       F.col("hi").alias("group_label"), F.when(has, F.col("lo")).alias("prev_label"))


def scatter(df: DataFrame, x: str, ys: Sequence[str], order_by: Sequence[str], limit: int | None = None) -> DataFrame:
    """Points (order_by…, x, y_<field>…) of the rows whose x is a number; of the first ``limit`` rows if that is given."""
    first = df if limit is None else df.orderBy(*order_by).limit(limit)
    return first.select(*order_by, number(x).alias("x"), *[number(y).alias(f"y_{y}") for y in ys]).filter("x IS NOT NULL")


def bubble(df: DataFrame, x: str, y: str, order_by: Sequence[str], r: str | None = None, limit: int | None = None) -> DataFrame:
    """Points (order_by…, x, y, r); a size that is no number is 0, no size field means 1; ``limit`` as for ``scatter``."""
    first = df if limit is None else df.orderBy(*order_by).limit(limit)
    size = F.coalesce(number(r), F.lit(0.0)) if r else F.lit(1.0)
    return first.select(*order_by, number(x).alias("x"), number(y).alias("y"), size.alias("r")).filter(
        "x IS NOT NULL AND y IS NOT NULL")


def stacked_bar(df: DataFrame, x: str, stack: str, value: str | None, top: int | None = None, bars: int | None = None) -> DataFrame:
    """(x, stack, value) of all cells, or of the ``top`` most frequent stacks and ``bars`` most frequent x (a top-k report)."""
    named = df.select(label(x).alias("x"), label(stack).alias("stack"), (number(value) if value else F.lit(1.0)).alias("v"))
    cells = named.groupBy("x", "stack").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("n"))

    def leaders(c: str, k: int) -> DataFrame:
        return cells.groupBy(c).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), c).limit(k).select(c)
    shown = cells
    for c, k in (("x", bars), ("stack", top)):
        if k is not None:
            shown = shown.join(leaders(c, k), c, "left_semi")
    return shown.select("x", "stack", rnd(F.coalesce("value", F.lit(0.0)), 4).alias("value"))

"""Column profiles.  Every figure is an aggregate; results are long tables, one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, number, numeric_columns, one_row, rnd
from .aggregate import duplicates
from .quantiles import quantiles, ranked_counts, value_counts

TOP_VALUES, HISTOGRAM_VALUES = 10, 20  # fixed values


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing, missing_pct, is_numeric); '' counts as missing."""
    def missing(c: str):
        gone = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, T.StringType):
            gone = gone | (F.col(c) == "")
        return F.count_if(gone)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[missing(c).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.lit(is_numeric(df, c)).alias("is_numeric"))
                     for i, c in enumerate(df.columns)])
    return counts.select("n", F.inline(rows)).select(
        "column", "missing", F.when(F.col("n") > 0, F.col("missing") / F.nullif(F.col("n"), F.lit(0)) * 100).otherwise(0.0).alias("missing_pct"), "is_numeric")


def distinct_with_null(df: DataFrame) -> DataFrame:
    """(column, uniq): distinct values per column, null counting as one value.  One shuffle for all columns."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])))
    return long.groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count(F.lit(1)).alias("uniq"))


def quality(df: DataFrame) -> DataFrame:
    """One row: total_rows, total_cols, duplicate_rows (all members), duplicate_extras, missing_cells, missing_cells_pct."""
    total = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0).cast("long"))
    dup = one_row(duplicates(df))
    k = len(df.columns)
    return total.select(
        F.col("n").alias("total_rows"), F.lit(k).alias("total_cols"), dup.getField("members").alias("duplicate_rows"),
        dup.getField("extras").alias("duplicate_extras"), cells.alias("missing_cells"),
        F.when(F.col("n") > 0, cells / F.nullif(F.col("n") * k, F.lit(0))).otherwise(0.0).alias("missing_cells_pct"))


def column_quality(df: DataFrame) -> DataFrame:
    """(column, missing, high_missing, constant_or_id); null counts as a value for the latter."""
    n = one_row(df.agg(F.count(F.lit(1)).alias("n"))).getField("n")
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).unpivot([], list(df.columns), "column", "missing")
    return (nulls.join(distinct_with_null(df), "column", "left").withColumn("n", n)
            .select("column", "missing", (F.col("missing") > F.col("n") * 0.5).alias("high_missing"),
                    ((F.col("uniq") == 1) | (F.col("uniq") == F.col("n"))).alias("constant_or_id")))


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, v) of all finite values."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in cols]))).filter("v IS NOT NULL")


def _moments(df: DataFrame, cols: Sequence[str], population: bool) -> DataFrame:
    var = F.var_pop if population else F.var_samp
    m = _long(df, cols).groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), var("v").alias("variance"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    return m.withColumns({"variance": F.coalesce("variance", F.lit(0.0)), "std": F.sqrt(F.coalesce("variance", F.lit(0.0))),
                          "skewness": F.when((F.col("n") >= 3) & ~F.isnan("skewness"), F.col("skewness")),
                          "kurtosis": F.when((F.col("n") >= 4) & ~F.isnan("kurtosis"), F.col("kurtosis"))})


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, variant: str = "sample") -> DataFrame:
    """n, mean, std, variance, min, max, p5 p25 median p75 p95, iqr, skewness, excess kurtosis, outliers_count.

    ``variant="sample"``: n-1 variance and inverted-CDF quantiles; ``"pop"``: population variance and
    linear quantiles.
    """
    cols = list(cols or numeric_columns(df))
    names = {"p5": .05, "p25": .25, "median": .5, "p75": .75, "p95": .95}
    q = quantiles(df, cols, list(names.values()), (), "linear" if variant == "pop" else "disc")
    q = q.select("column", *[F.col("q")[i].alias(k) for i, k in enumerate(names)]).withColumn("iqr", F.col("p75") - F.col("p25"))
    fence = q.select("column", (F.col("p25") - 1.5 * F.col("iqr")).alias("lo"), (F.col("p75") + 1.5 * F.col("iqr")).alias("hi"))
    out = _long(df, cols).join(F.broadcast(fence), "column").groupBy("column").agg(  # one fence row per column
        F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).alias("outliers_count"))
    return _moments(df, cols, variant == "pop").join(q, "column").join(out, "column")


def numeric_histograms(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """(column, bin, lo, hi, count) for all columns in one pass; empty bins are listed."""
    cols = list(cols or numeric_columns(df))
    values = _long(df, cols)
    lim = values.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    b = F.when(F.col("w") == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("w"), F.lit(0.0)))))
    hit = values.join(F.broadcast(lim), "column").groupBy("column", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = lim.withColumn("bin", F.explode(F.when(F.col("w") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))))
    return every.join(hit, ["column", "bin"], "left").select(
        "column", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"), F.coalesce("count", F.lit(0)).alias("count"))


def boxplots(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, min, q1, median, q3, max, w_low, w_high); ``outlier_values`` has what lies outside the fences."""
    return numeric_profile(df, cols).select(
        "column", "min", F.col("p25").alias("q1"), "median", F.col("p75").alias("q3"), "max",
        (F.col("p25") - 1.5 * F.col("iqr")).alias("w_low"), (F.col("p75") + 1.5 * F.col("iqr")).alias("w_high"))


def outlier_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, v, n): every value outside the fences of its box plot, with how often it comes."""
    cols = list(cols or numeric_columns(df))
    far = _long(df, cols).join(F.broadcast(boxplots(df, cols).select("column", "w_low", "w_high")), "column").filter("v < w_low OR v > w_high")
    return far.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))


def frequency_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, c) of non-null text values."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))


def categorical_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, n, unique, mode, mode_pct, rare_count); rare means below max(1, 1 %) of n, mode ties go to the smallest value."""
    freq = frequency_table(df, cols)
    base = freq.groupBy("column").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("unique"), F.max("c").alias("mc"))
    mode = freq.join(F.broadcast(base.select("column", "mc")), "column").filter("c = mc").groupBy("column").agg(F.min("value").alias("mode"))
    rare = freq.join(F.broadcast(base.select("column", "n")), "column").groupBy("column").agg(
        F.count_if(F.col("c") < F.greatest(F.lit(1.0), F.col("n") * 0.01)).alias("rare_count"))
    return base.join(mode, "column").join(rare, "column").select(
        "column", "n", "unique", "mode", (F.col("mc") / F.col("n")).alias("mode_pct"), "rare_count")


def top_values(df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, count, pct): the k most frequent values, ties by value (a top-k report)."""
    freq = frequency_table(df, cols)
    n = freq.groupBy("column").agg(F.sum("c").alias("n"))
    ranked = freq.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("c"), "value"))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(n), "column").select("column", "rank", "value", F.col("c").alias("count"), (F.col("c") / F.col("n")).alias("pct"))


def overview(profile: DataFrame) -> DataFrame:
    """The few figures of a numeric profile that a summary card shows."""
    return profile.select("column", "n", "mean", "median", "std", "min", "max", "outliers_count")


def column_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, min, max, mean, std, median) with population std, rounded to 8 digits."""
    cols = list(cols or numeric_columns(df))
    med = quantiles(df, cols, [0.5]).select("column", F.col("q")[0].alias("median"))
    return _moments(df, cols, True).join(med, "column").select(
        "column", *[rnd(c, 8).alias(c) for c in ("min", "max", "mean", "std", "median")])


def normality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Jarque-Bera (column, n, skewness, kurtosis, stat, p_value, is_normal, label, advice)."""
    m = _moments(df, list(cols or numeric_columns(df)), True)
    ok = (F.col("n") >= 8) & (F.col("variance") >= 1e-10)
    stat = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    out = m.select("column", "n", *[F.when(ok, F.col(c)).alias(c) for c in ("skewness", "kurtosis")], F.when(ok, stat).alias("stat"))
    out = out.withColumn("p_value", F.exp(-F.col("stat") / 2))
    return out.withColumns({"is_normal": F.coalesce(F.col("p_value") >= 0.05, F.lit(False)), "label": normality_label(), "advice": transform_advice()})


def normality_label():
    s, k, p = F.col("skewness"), F.col("kurtosis"), F.col("p_value")
    return (F.when(p > 0.05, "normal").when(F.abs(s) > 1, "strongly skewed").when(F.abs(k) > 3, "heavy tails")
            .when(F.abs(s) > 0.5, "moderately skewed").otherwise("not normal"))


def transform_advice():
    s = F.col("skewness")
    return (F.when(s > 1.5, "log").when(s > 0.5, "sqrt").when(s < -1.5, "reflect and log").when(s < -0.5, "reflect and sqrt").otherwise("none"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(value, count, pct, ratio, imbalance) with ratio = largest class / smallest; > 3 warns, > 10 is severe."""
    g = df.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    t = one_row(g.agg(F.sum("count").alias("n"), F.max("count").alias("hi"), F.min("count").alias("lo")))
    r = t.getField("hi") / t.getField("lo")
    return g.select("value", "count", (F.col("count") / t.getField("n")).alias("pct"), r.alias("ratio")).withColumn(
        "imbalance", F.when(F.col("ratio") > 10, "severe").when(F.col("ratio") > 3, "moderate").otherwise("balanced"))


def kde(df: DataFrame, col: str, points: int = 60) -> DataFrame:
    """(i, x, density): Gaussian kernel density at equally spaced points, Silverman bandwidth.

    One aggregate with a sum per point; rows are never multiplied by points.
    """
    v = df.select(number(col).alias("v")).filter("v IS NOT NULL")
    base = one_row(v.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_pop("v").alias("sd")))
    ranked = ranked_counts(value_counts(v, ["v"]))
    at = lambda p: F.min(F.when(F.col("cum") > F.floor(F.col("n") * p), F.col("v")))
    q = one_row(ranked.agg(at(0.25).alias("q1"), at(0.75).alias("q3")))
    n, lo, hi = (base.getField(f) for f in ("n", "lo", "hi"))
    sd = F.when(base.getField("sd") == 0, 1.0).otherwise(base.getField("sd"))
    iqr = q.getField("q3") - q.getField("q1")
    spread = F.least(sd, F.when(iqr == 0, sd).otherwise(iqr) / 1.34)
    h = F.greatest(F.lit(0.01), 0.9 * spread * F.pow(n.cast("double"), F.lit(-0.2)))
    rows = v.withColumns({"lo": lo, "w": hi - lo, "h": h})
    x = lambda i: F.col("lo") + F.col("w") * i / (points - 1)
    sums = rows.agg(F.first("lo").alias("lo"), F.first("w").alias("w"), F.first("h").alias("h"), F.count("v").alias("n"),
                    *[F.sum(F.exp(-0.5 * F.pow((x(i) - F.col("v")) / F.col("h"), F.lit(2)))).alias(f"s{i}") for i in range(points)])
    norm = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    return sums.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), x(i).alias("x"), (F.col(f"s{i}") / norm).alias("density")) for i in range(points)])))

"""Exact quantiles without a per-group value map.

``percentile`` keeps every distinct value of a group in one task.  Here values are counted with a normal partial
aggregation, the counts get running totals, and a quantile is the first value whose running total passes its place.
Buckets are counted first, then the values of those that hold a quantile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dealt, number, one_row
from .ordered import scan


def value_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, v, c): how often each number occurs."""
    wide = df.select(*by, *[number(c).alias(c) for c in cols])
    long = wide.unpivot(list(by), list(cols), "column", "v") if len(cols) > 1 else wide.select(
        *by, F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("v"))
    return long.filter("v IS NOT NULL").groupBy(*by, "column", "v").agg(F.count(F.lit(1)).alias("c"))


def ranked_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``cum`` (values up to and including v) and ``n`` (all values of the group)."""
    return scan(counts, {"cum": ("sum", F.col("c")), "n": ("total", F.col("c"))}, ["v"], [*by, "column"])


#: Steps of a bucket number in an e-fold of the value, and the size below which values share the middle bucket.
STEPS, LEAST = 2048, 2.0 ** -30
#: Parts of a bucket between its smallest and its largest value.
PARTS = 4096
#: Rows of the picked buckets up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def bucket(v: Column) -> Column:
    """A number that never falls when ``v`` rises: about half a thousandth of a value wide, the same at every scale."""
    size = F.least(F.log1p(F.abs(v) / LEAST) * STEPS, F.lit(1e9))
    return F.when(F.isnan(v), F.lit(1 << 40)).otherwise(F.floor(F.signum(v) * size).cast("long"))


def _ranks(p: float, method: str) -> tuple[Column, Column]:
    """The places, from 1, of the values on both sides of the p-quantile of ``n`` values."""
    if method == "disc":  # inverted CDF: smallest v with cum >= n * p
        at = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(float(p))))
        return at, at
    h = (F.col("n") - 1) * F.lit(float(p))
    return F.floor(h) + 1, F.ceil(h) + 1


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), method: str = "linear") -> DataFrame:
    """(by…, column, n, q array) of exact quantiles; ``method`` is ``linear`` or ``disc``.

    First the buckets of each group are counted, which combines in the tasks to a number that does not grow with the rows.
    Running totals over them tell which buckets hold the places that are asked for; of these alone the values are
    counted one by one, part by part, and of a bucket with a single value not even that.
    """
    key = [*by, "column"]
    wide = df.select(*by, *[number(c).alias(c) for c in cols])
    rows = wide.unpivot(list(by), list(cols), "column", "v") if len(cols) > 1 else wide.select(*by, F.lit(cols[0]).alias("column"), F.col(cols[0]).alias("v"))
    rows = rows.filter("v IS NOT NULL").withColumn("b", bucket(F.col("v")))
    buckets = rows.groupBy(*key, "b").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a group has as many buckets as the spread of its values, not its rows, asks for
    walk = Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counted = buckets.withColumns({"cum": F.sum("c").over(walk), "n": F.sum("c").over(Window.partitionBy(*key))})
    wanted = F.array_distinct(F.array(*[r.cast("long") for p in probs for r in _ranks(p, method)]))
    held = F.filter(wanted, lambda r: (r > F.col("cum") - F.col("c")) & (r <= F.col("cum")))
    picked = counted.withColumn("ranks", held).filter("size(ranks) > 0").select(*key, "b", "n", "lo", "hi", "ranks", (F.col("cum") - F.col("c")).alias("before"))
    plain = picked.filter("lo = hi").select(*key, "n", F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    wide_ones = picked.filter("lo <> hi").select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*key, "b"])], "n", "lo", "hi", "ranks", "before")
    same = F.lit(True)
    for i, c in enumerate([*key, "b"]):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    # two buckets at most for each quantile of a group: their number is known before they are
    most = len(cols) * 2 * len(probs) * (df.agg(F.approx_count_distinct(F.struct(*by))).head()[0] * 1.2 if by else 1)
    small = F.broadcast if most <= BROADCAST_ROWS else dealt
    inside = [*key, "b", "sub"]
    part = F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS)
    values = rows.join(small(wide_ones), same).withColumn("sub", part).groupBy(*inside, "v").agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("n"), F.min("ranks").alias("ranks"), F.min("before").alias("before"))
    # a bucket has PARTS parts of its own spread, of which again those with a wanted place are looked into
    parts = values.groupBy(*inside).agg(F.sum("c").alias("t"), F.min("ranks").alias("ranks"), F.min("before").alias("before"))
    below = F.col("before") + F.coalesce(F.sum("t").over(Window.partitionBy(*key, "b").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("below", below).withColumn("held", F.filter("ranks", lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("t")))).filter("size(held) > 0")
    parts = parts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(inside)], "below", "held")
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*inside).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = (values.join(small(parts), same & F.col("sub").eqNullSafe(F.col(f"__k{len(inside) - 1}"))).withColumn("upto", upto)
             .withColumn("rank", F.explode(F.filter("held", lambda r: (r > F.col("upto") - F.col("c")) & (r <= F.col("upto"))))).select(*key, "n", "rank", "v"))
    every = plain.unionByName(found)

    def value(p: float) -> Column:
        low, high = _ranks(p, method)
        lo, hi = (F.max(F.when(F.col("rank") == r, F.col("v"))) for r in (low, high))
        if method == "disc":
            return lo
        h = (F.col("n") - 1) * F.lit(float(p))
        return lo + (hi - lo) * F.max(h - F.floor(h))

    return every.groupBy(*key).agg(F.max("n").alias("n"), F.array(*[value(p) for p in probs]).alias("q"))


def quantile_scalars(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "linear"
) -> dict[str, list[Column]]:
    """Quantiles of whole columns as scalar-subquery columns: ``{col: [q…]}``."""
    q = quantiles(df, cols, probs, (), method)
    row = one_row(q.agg(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in cols]))
    return {c: [row.getField(c)[i] for i in range(len(probs))] for c in cols}

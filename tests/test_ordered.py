"""Ordered scans: same result for any partitioning, any chunk count, and with a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from planlens.operators import ordered as O
from planlens.operators import quantiles as Q
from planlens.operators import series as S


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them in one key; values with gaps and ties."""
    d = spark.range(3000).withColumns({
        "k": F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40),
        "t": (F.col("id") * 7919) % 1009,
        "v": F.when(F.col("id") % 11 != 0, ((F.col("id") * 31) % 97).cast("double"))})
    return d.cache()


def scan_all(df, by, chunks):
    specs = {"s": ("sum", F.col("v")), "sb": ("sum_before", F.col("v")), "n": ("count", F.col("v")), "l": ("last", F.col("v")), "lb": ("last_before", F.col("v")),
             "f": ("first", F.col("v")), "fa": ("first_after", F.col("v")), "m": ("max", F.col("v")), "tot": ("total", F.col("v"))}
    return O.scan(df, specs, ["t", "id"], by, chunks)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("parts,chunks", [(1, 2), (8, 8), (5, 64)])
def test_scan_equals_plain_window(skewed, by, parts, chunks):
    w = Window.partitionBy(*by).orderBy("t", "id")
    u, b = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select("id", F.sum("v").over(u).alias("s"), F.sum("v").over(b).alias("sb"), F.count("v").over(u).alias("n"), F.last("v", True).over(u).alias("l"),
                         F.last("v", True).over(b).alias("lb"), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("f"),
                         F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("fa"), F.max("v").over(u).alias("m"),
                         F.sum("v").over(Window.partitionBy(*by)).alias("tot")).orderBy("id").collect()
    got = scan_all(skewed.repartition(parts, F.rand(parts)), by, chunks).select(*want[0].__fields__).orderBy("id").collect()
    assert got == want


def test_hot_key_is_split(skewed):
    biggest = O.with_chunk(skewed, ["t", "id"], ["k"], 16).groupBy("__chunk", "k").count().agg(F.max("count")).head()[0]
    assert biggest < 1000 / 3  # the hot key alone has 1,000 rows


def test_scan_null_partition_key_and_empty(spark, skewed):
    d = skewed.withColumn("k", F.when(F.col("k") != 0, F.col("k")))
    assert scan_all(d, ["k"], 8).filter("k IS NULL").agg(F.max("n"), F.count("*")).head()[1] == d.filter("k IS NULL").count()
    assert scan_all(skewed.filter("id < 0"), ["k"], 8).count() == 0


@pytest.mark.parametrize("block", [7, 64, 100_000])
def test_framed_is_independent_of_blocks(skewed, block):
    w = Window.partitionBy("k").orderBy("t", "id")
    make = lambda w: {"lag": F.lag("v", 3).over(w), "avg": F.round(F.avg("v").over(w.rowsBetween(-2, 2)), 9)}
    want = skewed.select("id", *[c.alias(n) for n, c in make(w).items()]).orderBy("id").collect()
    assert O.framed(skewed, make, 3, 2, ["t", "id"], ["k"], block_rows=block).select("id", "lag", "avg").orderBy("id").collect() == want


@pytest.mark.parametrize("block", [50, 100_000])
def test_ewm_blocks(skewed, block):
    rows = skewed.filter("k = 0").orderBy("t", "id").collect()
    y, want = None, {}
    for r in rows:
        if r.v is not None:
            y = r.v if y is None else 0.3 * r.v + 0.7 * y
        want[r.id] = None if r.v is None else y
    got = {r.id: r.v for r in S.ewm(skewed, "v", 0.3, ["t", "id"], ["k"], block_rows=block).filter("k = 0").collect()}
    assert got.keys() == want.keys()
    assert all((a is None and got[i] is None) or abs(a - got[i]) < 1e-9 for i, a in want.items())


@pytest.mark.parametrize("method,fn", [("linear", "percentile"), ("disc", "percentile_disc")])
def test_quantiles_match_builtin(skewed, method, fn):
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = {r.k: [round(x, 9) for x in r.q] for r in Q.quantiles(skewed, ["v"], probs, ["k"], method).collect()}
    if method == "linear":
        e = [F.expr(f"percentile(v, {p})") for p in probs]
    else:
        e = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)") for p in probs]
    want = {r[0]: [round(x, 9) for x in r[1:]] for r in skewed.groupBy("k").agg(*[c.alias(f"q{i}") for i, c in enumerate(e)]).collect()}
    assert got == want


@pytest.mark.parametrize("method,fn", [("linear", "percentile(x, {})"), ("disc", "percentile_disc({}) WITHIN GROUP (ORDER BY x)")])
def test_quantiles_through_buckets_are_exact(spark, method, fn):
    """Continuous, tied (a third of the rows share one value) and mostly-null columns; values of one bucket; signs."""
    d = spark.range(150_000).select(F.sin(F.col("id") * 1.7).alias("a"), F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 31 % 1009).cast("double")).alias("b"),
                                    F.when(F.col("id") % 700 == 0, F.col("id") * 1.0).alias("c"), (1e9 + F.col("id") * 7919 % 150_001).alias("d"), ((F.col("id") * 31 % 2003 - 1000) * 1e-7).alias("e"))
    probs = [0.0, 0.0001, 0.05, 0.25, 0.5, 0.75, 0.9999, 1.0]
    got = {r.column: r for r in Q.quantiles(d, list("abcde"), probs, (), method).collect()}
    for c in "abcde":
        want = list(d.select(F.col(c).alias("x")).agg(*[F.expr(fn.format(p)) for p in probs]).head())
        assert got[c].n == d.filter(F.col(c).isNotNull()).count()
        assert [round(x, 9) for x in got[c].q] == [round(x, 9) for x in want]


@pytest.mark.parametrize("chunks", [2, 7, 40])
def test_known_neighbours(spark, chunks):
    """The two known points on each side, over ranges without any known point, for one series and for many."""
    import random

    from planlens.operators.ordered import known_neighbours
    r = random.Random(chunks)
    rows = [(k, t, None if r.random() < 0.85 else float(t), None if t % 3 else t * 2.0) for k in ("a", None, "c") for t in range(90 if k else 7)]
    d = spark.createDataFrame(rows, "k string, t long, x double, y double").repartition(6)
    got = {(g["k"], g["t"]): g for g in known_neighbours(d, {"x": F.col("x"), "y": F.col("y")}, ["t"], ["k"], chunks=chunks).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        g = got[k, t]
        assert g["__pos"] == t + 1
        for at, name in ((2, "x"), (3, "y")):
            known = [(o[1] + 1, o[at]) for o in rows if o[0] == k and o[at] is not None]
            left, right = [p for p in known if p[0] <= t][::-1], [p for p in known if p[0] > t + 1]
            want = [(left + [None] * 2)[0], (left + [None] * 2)[1], (right + [None] * 2)[0], (right + [None] * 2)[1]]
            have = [g[f"__{s}_{name}"] for s in ("b1", "b2", "a1", "a2")]
            assert [p and tuple(p) for p in have] == want, (k, t, name)

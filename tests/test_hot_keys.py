"""Joins with an aggregate on their key: AQE must be able to split the hot key of the row side."""

import pytest
from pyspark.sql import functions as F

from planlens.operators import association, joins, prepare

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k"}


@pytest.fixture
def hot(spark):
    """A third of the rows on one key; broadcasts off, low skew thresholds."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark.range(0, 60_000, 1, 16).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 2).alias("y"), F.uuid().alias("pad"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("encode", [
    lambda d: prepare.encode_count(d, "k"), lambda d: prepare.encode_target(d, "k", "y"), lambda d: prepare.encode_woe(d, "k", "y"),
    lambda d: joins.lookup(d, d.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k")])
def test_hot_key_is_split(hot, encode):
    out = encode(hot)
    assert len(out.collect()) == 60_000
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_bh_adjust_shares_ranks(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.04, 0.03, None, 0.9])], "i int, p_value double")
    got = {r.i: r.p_adj for r in association.bh_adjust(d).collect()}
    assert got[4] is None
    assert [round(got[i], 6) for i in (0, 1, 2, 3, 5)] == [0.05, 0.05, 0.05, 0.05, 0.9]

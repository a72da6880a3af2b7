"""Preparation steps on small columns: nulls, constants, all-null columns, both sides of each rule."""

import pytest
from pyspark.sql import functions as F

from planlens.operators import prepare as P
from planlens.operators import series as S
from planlens.operators import split as X

ORDER = ["i"]


def test_mean_and_median_fill(column, read):
    assert read(P.impute(column([1.0, None, 3.0]), {"v": {"method": "mean"}})) == [1, 2, 3]
    assert read(P.impute(column([1.0, None, 3.0, 5.0]), {"v": {"method": "median"}})) == [1, 3, 3, 5]


def test_mode_tie_goes_to_smallest(column, read):
    assert read(P.impute(column(["b", None, "a", "a", "b"], "string"), {"v": {"method": "mode"}})) == ["b", "a", "a", "a", "b"]


@pytest.mark.parametrize("kind,raw,want", [("double", "abc", 0.0), ("double", "", 0.0), ("long", "7", 7), ("long", "7.9", 7), ("string", "x", "x")])
def test_constant_is_coerced(column, read, kind, raw, want):
    assert read(P.impute(column([None], kind), {"v": {"method": "constant", "value": raw}})) == [want]


def test_fills_interpolation_and_drop(column, read):
    d = column([None, 1.0, None, None, 4.0, None])
    assert read(P.impute(d, {"v": {"method": "ffill"}}, ORDER)) == [None, 1, 1, 1, 4, 4]
    assert read(P.impute(d, {"v": {"method": "bfill"}}, ORDER)) == [1, 1, 4, 4, 4, None]
    assert read(P.impute(d, {"v": {"method": "linear"}}, ORDER)) == [None, 1, 2, 3, 4, None]
    assert read(P.impute(d, {"v": {"method": "drop"}})) == [1, 4]
    with pytest.raises(ValueError):
        P.impute(d, {"v": {"method": "ffill"}})


def test_unknown_column_is_ignored(column, read):
    assert read(P.impute(column([1.0]), {"nope": {"method": "mean"}})) == [1]


@pytest.mark.parametrize("method", ["standard", "center_only", "unit_variance", "minmax", "minmax_sym", "maxabs", "robust", "percentile"])
def test_scale_all_null_and_constant(column, read, method):
    assert read(P.scale(column([None, None]), {"v": {"method": method}})) == [None, None]
    assert all(v is not None for v in read(P.scale(column([5.0, 5.0, 5.0]), {"v": {"method": method}})))


def test_scale_values(column, read):
    d = column([0.0, 5.0, 10.0])
    assert read(P.scale(d, {"v": {"method": "minmax"}})) == [0, 0.5, 1]
    assert read(P.scale(d, {"v": {"method": "minmax_sym"}})) == [-1, 0, 1]
    assert read(P.scale(d, {"v": {"method": "standard"}})) == [-1, 0, 1]
    assert [round(x, 6) for x in read(P.scale(d, {"v": {"method": "standard"}}, ddof=0))] == [-1.224745, 0, 1.224745]


@pytest.mark.parametrize("method", ["iqr", "zscore", "robust_zscore", "percentile"])
def test_outliers_all_null(column, method):
    assert P.remove_outliers(column([None, None]), {"v": {"method": method}}).count() == 2


def test_outliers(column, read):
    assert read(P.remove_outliers(column([1.0, 2.0, 3.0, 100.0, None]), {"v": {"method": "iqr", "iqrK": 1.0}})) == [1, 2, 3, None]
    assert 1000.0 not in read(P.remove_outliers(column([1.0] * 10 + [1000.0]), {"v": {"method": "zscore", "zThreshold": 2}}))
    prev = P.preview_outliers(column([1.0] * 10 + [1000.0]), {"v": {"method": "iqr"}}).head()
    assert (prev.total, prev.outliers) == (11, 1)


def test_label_and_ordinal(column, read):
    d = column(["b", "a", "B", None], "string", "c")
    assert read(P.encode(d, {"c": {"method": "label"}}), "c") == [2, 0, 1, 3]
    assert read(P.encode(d, {"c": {"method": "ordinal", "ordinalOrder": ["b", "a"]}}), "c") == [0, 1, 2, 2]


def test_counts_keep_null(column, read):
    d = column(["a", "b", "a", None], "string", "c")
    assert read(P.encode(d, {"c": {"method": "count"}}), "c") == [2, 1, 2, None]
    assert read(P.encode(d, {"c": {"method": "frequency"}}), "c") == [0.5, 0.25, 0.5, None]


def test_onehot_names_and_guard(column):
    d = column(["x", "y", "x", None], "string", "c")
    out = P.encode(d, {"c": {"method": "onehot"}})
    assert out.columns == ["i", "c__x", "c__y"]
    assert [tuple(r)[1:] for r in out.orderBy("i").collect()] == [(1, 0), (0, 1), (1, 0), (0, 0)]
    with pytest.raises(ValueError):
        P.encode_onehot(d, "c", max_categories=1)


def test_target_encodings(spark, read):
    d = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, None, 7.0)], "i int, c string, y double")
    assert read(P.encode(d, {"c": {"method": "target", "targetField": "y"}}), "c") == [2, 2, 5, 4]
    assert read(P.encode(d, {"c": {"method": "loo", "targetField": "y"}}), "c") == [3, 1, 4, 4]
    one_class = d.withColumn("y", F.lit(1.0))
    assert read(P.encode(one_class, {"c": {"method": "woe", "targetField": "y"}}), "c") == ["a", "a", "b", None]


def test_steps_run_in_order_and_skip_unknown(column, read):
    steps = [{"type": "impute", "config": {"v": {"method": "mean"}}}, {"type": "mystery"}, {"type": "scale", "config": {"v": {"method": "minmax"}}}]
    assert read(P.run_steps(column([0.0, None, 10.0]), steps)) == [0, 0.5, 1]


def test_long_chain_is_cut_and_stays_right(column, read):
    fill = {"type": "impute", "config": {"v": {"method": "ffill"}}}
    diff = {"type": "timeseries", "config": {"method": "rolling_mean", "fields": ["v"], "window": 1}}
    assert read(P.run_steps(column([1.0, None, 3.0]), [fill, diff, fill, diff, fill], ORDER)) == [1, 1, 3]


@pytest.mark.parametrize("method", ["mean_fill", "median_fill", "ffill", "bfill", "linear", "rolling_mean_fill", "polynomial_fill", "spline_fill", "rolling_mean", "rolling_median",
                                    "ewm", "log_transform", "boxcox", "diff", "seasonal_diff", "normalize", "standardize"])
def test_timeseries_all_null(column, read, method):
    assert read(S.timeseries(column([None, None, None]), {"method": method, "fields": ["v"], "window": 2}, ORDER)) == [None] * 3


def test_timeseries_values(column, read):
    d = column([1.0, None, 4.0, 9.0, None, 25.0])
    ts = lambda **c: read(S.timeseries(d, {"fields": ["v"], **c}, ORDER))
    assert ts(method="polynomial_fill")[1] == 2.5          # one point before: a line
    assert round(ts(method="polynomial_fill")[4], 9) == 16.0  # parabola through 3, 4 and 6
    assert ts(method="diff", window=1) == [None, None, None, 5, None, None]
    assert ts(method="rolling_mean", window=3) == [1, 2.5, 6.5, 6.5, 17, 25]
    assert ts(method="ewm", alpha=0.5) == [1, None, 2.5, 5.75, None, 15.375]
    assert S.timeseries(d, {"method": "lag_feature", "fields": ["v"], "window": 2}, ORDER).columns == ["i", "v", "v_lag2"]


def test_window_split_bad_text(column, read):
    d = column(["2021-01-03 05:06:07", "nonsense"], "string", "d")
    assert read(S.window_split(d, "d", "yearweek"), "d_yearweek") == ["2020-W53", None]
    assert read(S.window_split(d, "d", "hourminute"), "d_hourminute") == ["05:06", None]


def test_durbin_levinson_of_ar1():
    assert [round(x, 9) for x in S.durbin_levinson([1, 0.5, 0.25, 0.125])] == [1, 0.5, 0, 0]


def test_splits_cover_all_rows_once(spark):
    d = spark.range(101).withColumn("g", F.col("id") % 7)
    for out, col in ((X.random_split(d, ["id"], [0.7, 0.2]), "split"), (X.group_split(d, "g", [0.6]), "split"), (X.kfold(d, 4, ["id"]), "fold")):
        assert out.count() == 101 and out.filter(F.col(col).isNull()).count() == 0
    folds = {r.fold: r["count"] for r in X.kfold(d, 4, ["id"]).groupBy("fold").count().collect()}
    assert folds == {1: 25, 2: 25, 3: 25, 4: 26}
    again = X.random_split(d.repartition(5), ["id"], [0.7]).filter("split = 'train'").select("id")
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in X.random_split(d.coalesce(1), ["id"], [0.7]).filter("split = 'train'").select("id").collect())

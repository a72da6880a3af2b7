"""Preparation steps, time series and splits on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..operators import series as S
from ..operators import split as X
from .base import query
from .stats import rounded

# a table with gaps, written the same way on both sides
SRC = """(SELECT event_id AS id, user_id AS u, ts, event_type AS cat, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37) % 11 END AS k, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS c, CAST(event_id % 3 = 0 AS INT) AS y FROM events)"""
ORDER = ["ts", "id"]
W = "PARTITION BY u ORDER BY ts, id"


def src(t):
    i = F.col("event_id")
    return t.events.select(
        i.alias("id"), F.col("user_id").alias("u"), "ts", F.col("event_type").alias("cat"), F.when(i % 7 != 0, F.col("value")).alias("v"),
        F.when(i % 5 != 0, (i * 37) % 11).alias("k"), F.when(i % 13 != 0, F.col("event_type")).alias("c"), (i % 3 == 0).cast("int").alias("y"))


# --- impute -----------------------------------------------------------------------------------

@query("imp1_mean_median", f"SELECT id, round(coalesce(v, (SELECT avg(v) FROM {SRC})), 6) AS v, coalesce(k::DOUBLE, (SELECT quantile_cont(k, 0.5) FROM {SRC})) AS k FROM {SRC}")
def _(t):
    return rounded(P.impute(src(t), {"v": {"method": "mean"}, "k": {"method": "median"}}).select("id", "v", "k"), 6, "v")


@query("imp2_mode", f"SELECT id, coalesce(k, (SELECT k FROM {SRC} WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)) AS k, coalesce(c, (SELECT c FROM {SRC} WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c FROM {SRC}")
def _(t):
    return P.impute(src(t), {"k": {"method": "mode"}, "c": {"method": "mode"}}).select("id", "k", "c")


@query("imp3_constant", f"SELECT id, coalesce(v, 0) AS v, coalesce(k, 7) AS k, coalesce(c, 'none') AS c FROM {SRC}")
def _(t):
    return P.impute(src(t), {"v": {"method": "constant", "value": "abc"}, "k": {"method": "constant", "value": "7"}, "c": {"method": "constant", "value": "none"}}).select("id", "v", "k", "c")


@query("imp4_fill", f"SELECT id, last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS v, first_value(k IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k FROM {SRC}")
def _(t):
    return P.impute(src(t), {"v": {"method": "ffill"}, "k": {"method": "bfill"}}, ORDER, ["u"]).select("id", "v", "k")


@query("imp4_fill_global", f"SELECT id, last_value(v IGNORE NULLS) OVER (ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS v FROM {SRC}")
def _(t):
    return P.impute(src(t), {"v": {"method": "ffill"}}, ORDER).select("id", "v")


LINEAR = """WITH n AS (SELECT *, row_number() OVER ({o}) AS i FROM {src}), p AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ({p} ORDER BY i ROWS UNBOUNDED PRECEDING) AS li,
 last_value(v IGNORE NULLS) OVER ({p} ORDER BY i ROWS UNBOUNDED PRECEDING) AS lv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ({p} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri,
 first_value(v IGNORE NULLS) OVER ({p} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM n)
SELECT id, round(coalesce(v, lv + (rv - lv) / (ri - li) * (i - li)), 6) AS v FROM p"""


@query("imp5_linear", LINEAR.format(o="ORDER BY ts, id", p="", src=SRC))
def _(t):
    return rounded(P.impute(src(t), {"v": {"method": "linear"}}, ORDER).select("id", "v"), 6, "v")


@query("imp6_drop", f"SELECT id FROM {SRC} WHERE v IS NOT NULL AND c IS NOT NULL")
def _(t):
    return P.impute(src(t), {"v": {"method": "drop"}, "c": {"method": "drop"}}).select("id")


# --- scale ------------------------------------------------------------------------------------

SCALES = {
    "scl1_standard": ("standard", "(v - avg(v) OVER ()) / stddev_samp(v) OVER ()"),
    "scl2_center": ("center_only", "v - avg(v) OVER ()"),
    "scl3_unit_variance": ("unit_variance", "v / stddev_samp(v) OVER ()"),
    "scl4_minmax": ("minmax", "(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())"),
    "scl5_minmax_sym": ("minmax_sym", "2 * (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) - 1"),
    "scl6_maxabs": ("maxabs", "v / max(abs(v)) OVER ()"),
    "scl7_robust": ("robust", "(v - quantile_cont(v, 0.5) OVER ()) / (quantile_cont(v, 0.75) OVER () - quantile_cont(v, 0.25) OVER ())"),
    "scl8_percentile": ("percentile", "CASE WHEN v IS NOT NULL THEN least(1, greatest(0, (v - quantile_cont(v, 0.05) OVER ()) / (quantile_cont(v, 0.95) OVER () - quantile_cont(v, 0.05) OVER ()))) END")}
for _name, (_method, _sql) in SCALES.items():
    def _scale(m):
        return lambda t: rounded(P.scale(src(t), {"v": {"method": m}}).select("id", "v"), 6, "v")
    query(_name, f"SELECT id, round({_sql}, 6) AS v FROM {SRC}")(_scale(_method))


# --- encode -----------------------------------------------------------------------------------

def _enc(method, **kw):
    return lambda t: P.encode(src(t), {"c": {"method": method, **kw}}).select("id", "c")


def _enc8(method, digits=6, **kw):
    return lambda t: rounded(P.encode(src(t), {"c": {"method": method, **kw}}).select("id", "c"), digits, "c")


query("enc1_label", f"WITH d AS (SELECT c, row_number() OVER (ORDER BY lower(c), c) - 1 AS code FROM (SELECT DISTINCT c FROM {SRC} WHERE c IS NOT NULL)) SELECT id, coalesce(code, (SELECT count(*) FROM d)) AS c FROM {SRC} s LEFT JOIN d ON s.c = d.c")(_enc("label"))
query("enc2_ordinal", f"SELECT id, CAST(CASE c WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS BIGINT) AS c FROM {SRC}")(_enc("ordinal", ordinalOrder=["purchase", "click"]))
query("enc3_frequency", f"SELECT id, round(n / (SELECT count(*) FROM events), 6) AS c FROM {SRC} s LEFT JOIN (SELECT c AS g, count(*) AS n FROM {SRC} GROUP BY 1) ON g = s.c")(_enc8("frequency"))
query("enc4_count", f"SELECT id, n AS c FROM {SRC} s LEFT JOIN (SELECT c AS g, count(*) AS n FROM {SRC} GROUP BY 1) ON g = s.c")(_enc("count"))


@query("enc5_onehot", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus__F", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus__O", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus__P" FROM orders""")
def _(t):
    return P.encode(t.orders.select("o_orderkey", "o_orderstatus"), {"o_orderstatus": {"method": "onehot"}})


CAT = f"(SELECT c AS g, sum(v) AS s, count(v) AS n, count(*) FILTER (y = 1) AS e, count(*) FILTER (y = 0) AS z FROM {SRC} GROUP BY 1)"
query("enc6_target", f"SELECT id, round(coalesce(s / n, (SELECT avg(v) FROM {SRC})), 6) AS c FROM {SRC} s LEFT JOIN {CAT} ON g = c")(_enc8("target", targetField="v"))
query("enc7_leave_one_out", f"SELECT id, round(CASE WHEN n > 1 THEN round((s - v) / (n - 1), 8) ELSE (SELECT avg(v) FROM {SRC}) END, 4) AS c FROM {SRC} s LEFT JOIN {CAT} ON g = c")(_enc8("loo", 4, targetField="v"))
query("enc8_weight_of_evidence", f"SELECT id, CASE WHEN g IS NOT NULL THEN round(ln((greatest(e, 0.5) / (SELECT count(*) FROM {SRC} WHERE y = 1)) / (greatest(z, 0.5) / (SELECT count(*) FROM {SRC} WHERE y = 0))), 6) END AS c FROM {SRC} s LEFT JOIN {CAT} ON g = c")(_enc8("woe", targetField="y"))


# --- outliers ---------------------------------------------------------------------------------

BOUNDS = {
    "out1_iqr": ({"method": "iqr", "iqrK": 0.4}, "SELECT q1 - 0.4 * (q3 - q1) AS lo, q3 + 0.4 * (q3 - q1) AS hi FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM S)"),
    "out2_zscore": ({"method": "zscore", "zThreshold": 1.5}, "SELECT avg(v) - 1.5 * stddev_samp(v) AS lo, avg(v) + 1.5 * stddev_samp(v) AS hi FROM S"),
    "out3_robust_zscore": ({"method": "robust_zscore", "zThreshold": 1.2}, "SELECT m - 1.2 * d / 0.6745 AS lo, m + 1.2 * d / 0.6745 AS hi FROM (SELECT any_value(m) AS m, quantile_cont(abs(v - m), 0.5) AS d FROM S, (SELECT quantile_cont(v, 0.5) AS m FROM S))"),
    "out4_percentile": ({"method": "percentile"}, "SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM S")}
for _name, (_cfg, _sql) in BOUNDS.items():
    def _out(cfg):
        return lambda t: P.remove_outliers(src(t), {"v": cfg}).select("id")
    query(_name, f"SELECT id FROM {SRC}, ({_sql.replace('FROM S', 'FROM ' + SRC)}) WHERE v IS NULL OR v BETWEEN lo AND hi")(_out(_cfg))


@query("out5_preview", f"""
WITH b AS (SELECT q1 - 0.4 * (q3 - q1) AS lo, q3 + 0.4 * (q3 - q1) AS hi FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM {SRC}))
SELECT 'v' AS "column", count(v) AS total, count(*) FILTER (v < lo OR v > hi) AS outliers, round(lo, 6) AS lower, round(hi, 6) AS upper FROM {SRC}, b GROUP BY lo, hi""")
def _(t):
    return rounded(P.preview_outliers(src(t), {"v": {"method": "iqr", "iqrK": 0.4}}), 6, "lower", "upper")


@query("pip1_steps", f"""
WITH a AS (SELECT id, coalesce(v, (SELECT avg(v) FROM {SRC})) AS v, c, ts FROM {SRC}), b AS (SELECT * FROM a, (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM a)),
 d AS (SELECT * FROM b WHERE v BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1))
SELECT id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v, n AS c, strftime(ts, '%Y-%m') AS ts_yearmonth FROM d LEFT JOIN (SELECT c AS g, count(*) AS n FROM d GROUP BY 1) ON g = d.c""")
def _(t):
    steps = [{"type": "impute", "config": {"v": {"method": "mean"}}}, {"type": "outliers", "config": {"v": {"method": "iqr", "iqrK": 0.5}}}, {"type": "something_else"},
             {"type": "scale", "config": {"v": {"method": "minmax"}}}, {"type": "encode", "config": {"c": {"method": "count"}}},
             {"type": "window_split", "config": {"field": "ts", "unit": "yearmonth"}}]
    return rounded(P.run_steps(src(t), steps).select("id", "v", "c", "ts_yearmonth"), 6, "v")


# --- time series ------------------------------------------------------------------------------

def _ts(method, fields=("v",), digits=6, cols=("id", "v"), **cfg):
    def run(t):
        out = S.timeseries(src(t), {"method": method, "fields": list(fields), **cfg}, ORDER, ["u"]).select(*cols)
        return rounded(out, digits, *[c for c in cols if c != "id"])
    return run


query("tsr1_mean_fill", f"SELECT id, round(coalesce(v, (SELECT avg(v) FROM {SRC})), 6) AS v FROM {SRC}")(_ts("mean_fill"))
query("tsr1_median_fill", f"SELECT id, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM {SRC})), 6) AS v FROM {SRC}")(_ts("median_fill"))
query("tsr2_ffill", f"SELECT id, round(last_value(v IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS v FROM {SRC}")(_ts("ffill"))
query("tsr2_bfill", f"SELECT id, round(first_value(v IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS v FROM {SRC}")(_ts("bfill"))
query("tsr3_linear", LINEAR.format(o=W, p="PARTITION BY u", src=SRC))(_ts("linear"))
query("tsr4_rolling_mean_fill", f"SELECT id, round(coalesce(v, avg(v) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), 6) AS v FROM {SRC}")(_ts("rolling_mean_fill", window=5))
NEAR = """WITH n AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ts, id)::DOUBLE AS x FROM SRC), k AS (SELECT u, x, v AS y, lag(x) OVER w AS px, lag(v) OVER w AS py, lead(x) OVER w AS nx, lead(v) OVER w AS ny FROM n WHERE v IS NOT NULL WINDOW w AS (PARTITION BY u ORDER BY x)),
 g AS (SELECT n.id, n.x, n.v, b.x AS x1, b.y AS y1, b.px AS x0, b.py AS y0, a.x AS x2, a.y AS y2, a.nx AS x3, a.ny AS y3 FROM n ASOF LEFT JOIN k b ON n.u = b.u AND n.x >= b.x ASOF LEFT JOIN k a ON n.u = a.u AND n.x <= a.x)""".replace("SRC", SRC)
query("tsr5_polynomial_fill", NEAR + """ SELECT id, round(CASE WHEN v IS NOT NULL THEN v WHEN x1 IS NULL OR x2 IS NULL THEN NULL WHEN x0 IS NULL THEN y1 + (y2 - y1) * (x - x1) / (x2 - x1)
 ELSE y0 * (x - x1) * (x - x2) / ((x0 - x1) * (x0 - x2)) + y1 * (x - x0) * (x - x2) / ((x1 - x0) * (x1 - x2)) + y2 * (x - x0) * (x - x1) / ((x2 - x0) * (x2 - x1)) END, 6) AS v FROM g""")(_ts("polynomial_fill"))
query("tsr6_spline_fill", NEAR + """, h AS (SELECT *, (x - x1) / (x2 - x1) AS t, coalesce(y0, 2 * y1 - y2) AS a, coalesce(y3, 2 * y2 - y1) AS d FROM g)
 SELECT id, round(coalesce(v, 0.5 * (2 * y1 + (y2 - a) * t + (2 * a - 5 * y1 + 4 * y2 - d) * t * t + (3 * y1 - a - 3 * y2 + d) * t * t * t)), 6) AS v FROM h""")(_ts("spline_fill"))
query("tsr7_rolling_mean", f"SELECT id, round(avg(v) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS v FROM {SRC}")(_ts("rolling_mean", window=4))
query("tsr8_rolling_median", f"SELECT id, round(quantile_cont(v, 0.5) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS v FROM {SRC}")(_ts("rolling_median", window=5))


@query("tsr9_ewm", """
WITH RECURSIVE n AS (SELECT event_id AS id, user_id AS u, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_id % 7 <> 0),
 r AS (SELECT id, u, i, v FROM n WHERE i = 1 UNION ALL SELECT n.id, n.u, n.i, 0.3 * n.v + 0.7 * r.v FROM r JOIN n ON n.u = r.u AND n.i = r.i + 1)
SELECT event_id AS id, round(r.v, 6) AS v FROM events LEFT JOIN r ON r.id = event_id""")
def _(t):
    return _ts("ewm", alpha=0.3)(t)


query("tsr10_log", f"SELECT id, CASE WHEN v - 50 > 0 THEN round(ln(v - 50), 6) END AS v FROM {SRC}")(
    lambda t: rounded(S.timeseries(src(t).withColumn("v", F.col("v") - 50), {"method": "log_transform", "fields": ["v"]}).select("id", "v"), 6, "v"))
query("tsr11_boxcox", f"SELECT id, CASE WHEN v > 0 THEN round((pow(v, 0.5) - 1) / 0.5, 6) END AS v FROM {SRC}")(_ts("boxcox", **{"lambda": 0.5}))
query("tsr12_diff", f"SELECT id, round(v - lag(v, 1) OVER ({W}), 6) AS v FROM {SRC}")(_ts("diff", window=1))
query("tsr13_seasonal_diff", f"SELECT id, round(v - lag(v, 7) OVER ({W}), 6) AS v FROM {SRC}")(_ts("seasonal_diff", window=7))
query("tsr14_lag_feature", f"SELECT id, round(v, 6) AS v, round(lag(v, 3) OVER ({W}), 6) AS v_lag3 FROM {SRC}")(_ts("lag_feature", cols=("id", "v", "v_lag3"), window=3))
query("tsr15_normalize", f"SELECT id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS v FROM {SRC}")(_ts("normalize"))
query("tsr16_standardize", f"SELECT id, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS v FROM {SRC}")(_ts("standardize", ddof=0))

for _unit, _sql in {"year": "year(ts)", "yearmonth": "strftime(ts, '%Y-%m')", "yearweek": "strftime(ts, '%G-W%V')", "day": "strftime(ts, '%Y-%m-%d')",
                    "hour": "hour(ts)", "hourminute": "strftime(ts, '%H:%M')", "second": "strftime(ts, '%H:%M:%S')"}.items():
    def _wsp(unit):
        return lambda t: S.window_split(t.events.select("event_id", "ts"), "ts", unit).drop("ts")
    query(f"wsp1_window_{_unit}", f"SELECT event_id, {_sql} AS ts_{_unit} FROM events")(_wsp(_unit))


# --- splits -----------------------------------------------------------------------------------

RN = "SELECT *, row_number() OVER ({o}) AS rn, count(*) OVER ({p}) AS n FROM {t}"
THREE = "CASE WHEN rn <= floor(n * 0.7 + 0.5) THEN 'train' WHEN rn <= floor(n * 0.7 + 0.5) + floor(n * 0.2 + 0.5) THEN 'test' ELSE 'valid' END"


@query("spl1_ordered_cut", f"SELECT o_orderkey, {THREE} AS split FROM ({RN.format(o='ORDER BY o_orderkey', p='', t='orders')})")
def _(t):
    return X.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], [0.7, 0.2], seed=None)


@query("spl1_random", "SELECT split, CASE split WHEN 'train' THEN floor(n * 0.8 + 0.5) ELSE n - floor(n * 0.8 + 0.5) END::BIGINT AS rows FROM (SELECT count(*) AS n FROM orders), (VALUES ('train'), ('test')) v(split)")
def _(t):
    return X.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], [0.8]).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@query("spl2_stratified", f"SELECT o_orderkey, {THREE} AS split FROM ({RN.format(o='PARTITION BY o_orderpriority ORDER BY o_orderkey', p='PARTITION BY o_orderpriority', t='orders')})")
def _(t):
    return X.stratified_split(t.orders, "o_orderpriority", ["o_orderkey"], [0.7, 0.2], seed=None).select("o_orderkey", "split")


@query("spl2_stratified_random", "SELECT o_orderpriority, 'train' AS split, floor(count(*) * 0.8 + 0.5)::BIGINT AS rows FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'test', (count(*) - floor(count(*) * 0.8 + 0.5))::BIGINT FROM orders GROUP BY 1")
def _(t):
    return X.stratified_split(t.orders, "o_orderpriority", ["o_orderkey"], [0.8]).groupBy("o_orderpriority", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("spl3_time", f"SELECT o_orderkey, {THREE} AS split FROM ({RN.format(o='ORDER BY d NULLS LAST, o_orderkey', p='', t='(SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)')})")
def _(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderdate")).alias("d"))
    return X.time_split(d, "d", ["o_orderkey"], [0.7, 0.2]).select("o_orderkey", "split")


@query("spl4_group", f"WITH g AS (SELECT o_custkey, {THREE} AS split FROM ({RN.format(o='ORDER BY o_custkey', p='', t='(SELECT DISTINCT o_custkey FROM orders)')})) SELECT o_orderkey, split FROM orders JOIN g USING (o_custkey)")
def _(t):
    return X.group_split(t.orders, "o_custkey", [0.7, 0.2], seed=None).select("o_orderkey", "split")


@query("spl5_kfold", f"SELECT o_orderkey, least(7, floor((rn - 1) / floor(n / 7)) + 1)::INT AS fold FROM ({RN.format(o='ORDER BY o_orderkey', p='', t='orders')})")
def _(t):
    return X.kfold(t.orders, 7, ["o_orderkey"], seed=None).select("o_orderkey", "fold")


# --- time-series analysis ---------------------------------------------------------------------

E = ["ts", "event_id"]


@query("tsa1_base_series", "SELECT ts AS x, value AS y, event_id FROM events")
def _(t):
    return S.base_series(t.events, "ts", "value", E)


@query("tsa1_count_series", "SELECT strftime(ts, '%Y-%m-%d') AS x, count(*) AS y FROM events GROUP BY 1")
def _(t):
    return S.base_series(t.events.withColumn("d", F.date_format("ts", "yyyy-MM-dd")), "d", None, ["d"])


ACF = """WITH n AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 s AS (SELECT user_id, any_value(n) AS n, sum(d * d) AS s0 FROM n GROUP BY 1), l AS (SELECT a.user_id, a.i - b.i AS lag, sum(a.d * b.d) AS s FROM n a JOIN n b ON a.user_id = b.user_id AND a.i - b.i BETWEEN 0 AND 6 GROUP BY 1, 2)"""


@query("tsa2_acf", ACF + " SELECT user_id, lag::INT AS lag, round(s / s0, 6) AS acf, round(1.96 / sqrt(n), 8) AS band FROM l JOIN s USING (user_id) WHERE lag <= n // 2")
def _(t):
    return rounded(rounded(S.acf(t.events, "value", 6, E, ["user_id"]), 6, "acf"), 8, "band")


@query("tsa3_pacf", ACF + """, r AS (SELECT user_id, max(s / s0) FILTER (lag = 1) AS a, max(s / s0) FILTER (lag = 2) AS b FROM l JOIN s USING (user_id) WHERE n >= 4 GROUP BY 1)
 SELECT user_id, 0 AS lag, 1.0::DOUBLE AS pacf FROM r UNION ALL SELECT user_id, 1, round(a, 6) FROM r UNION ALL SELECT user_id, 2, round((b - a * a) / (1 - a * a), 6) FROM r""")
def _(t):
    return rounded(S.pacf(t.events, "value", 2, E, ["user_id"]), 6, "pacf").drop("band")


DEC = """WITH n AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 t AS (SELECT *, CASE WHEN i > 3 AND i <= n - 3 THEN m END AS trend, (i - 1) % 7 AS ph FROM n), p AS (SELECT user_id, ph, coalesce(avg(value - trend), 0) AS s FROM t GROUP BY 1, 2)"""


@query("tsa4_decompose", DEC + " SELECT event_id, round(trend, 6) AS trend, CASE WHEN trend IS NOT NULL THEN round(s, 6) END AS seasonal, round(value - trend - s, 6) AS residual FROM t JOIN p USING (user_id, ph)")
def _(t):
    return rounded(S.decompose(t.events, "value", 7, E, ["user_id"]).select("event_id", "trend", "seasonal", "residual"), 6, "trend", "seasonal", "residual")


@query("tsa5_rolling_band", """
SELECT event_id, CASE WHEN c = 6 THEN round(m, 6) END AS rm, CASE WHEN c = 6 THEN round(m + s, 6) END AS upper, CASE WHEN c = 6 THEN round(m - s, 6) END AS lower FROM (
 SELECT event_id, count(*) OVER w AS c, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""")
def _(t):
    return rounded(S.rolling_band(t.events, "value", 6, E).select("event_id", "rm", "upper", "lower"), 6, "rm", "upper", "lower")


DAILY = "(SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) / 1000 AS y FROM orders GROUP BY 1)"


def daily(t):
    return t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum("o_totalprice") / 1000).alias("y"))


SPECTRUM = f"""WITH s AS (SELECT y - avg(y) OVER () AS v, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM {DAILY}),
 p AS (SELECT k, any_value(n) AS n, (pow(sum(v * cos(2 * pi() * ((i * k) % n) / n)), 2) + pow(sum(v * sin(2 * pi() * ((i * k) % n) / n)), 2)) / any_value(n) AS power FROM s, (SELECT unnest(range(1, (SELECT max(n) // 2 + 1 FROM s))) AS k) GROUP BY k)"""


@query("tsa6_periodogram", SPECTRUM + " SELECT k::INT AS k, round(k / n, 8) AS freq, round(n / k, 6) AS period, round(power, 2) AS power FROM p")
def _(t):
    return rounded(rounded(rounded(S.periodogram(daily(t), "y", ["d"]), 8, "freq"), 6, "period"), 2, "power")


@query("tsa6_top_periods", SPECTRUM + " SELECT k::INT AS k, round(power, 2) AS power FROM p ORDER BY power DESC, k LIMIT 3")
def _(t):
    return rounded(S.top_periods(S.periodogram(daily(t), "y", ["d"])), 2, "power").select("k", "power")


@query("tsa7_stationarity", f"""
WITH s AS (SELECT y - avg(y) OVER () AS v, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS n FROM {DAILY})
SELECT (a.i - b.i)::INT AS lag, round(sum(a.v * b.v) / (SELECT sum(v * v) FROM s), 6) AS acf, round(1.96 / sqrt(any_value(a.n)), 8) AS band FROM s a JOIN s b ON a.i - b.i BETWEEN 0 AND 10 GROUP BY 1""")
def _(t):
    return rounded(rounded(S.stationarity(daily(t), "y", 7, 10, ["d"])[1], 6, "acf"), 8, "band")


@query("tsa8_seasonal_box", """
WITH r AS (SELECT month(o_orderdate) AS g, o_totalprice AS v, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY month(o_orderdate)) AS n FROM orders)
SELECT g AS "group", max(v) FILTER (i = floor(n * 0.25)) AS q1, max(v) FILTER (i = floor(n * 0.5)) AS median, max(v) FILTER (i = floor(n * 0.75)) AS q3, min(v) AS min, max(v) AS max, round(avg(v), 2) AS mean FROM r GROUP BY 1""")
def _(t):
    return rounded(S.seasonal_box(t.orders, "o_orderdate", "o_totalprice"), 2, "mean")


@query("tsa9_seasonal_overlay", "SELECT dayofweek(ts) + 1 AS key, row_number() OVER (PARTITION BY dayofweek(ts) ORDER BY ts, event_id) AS i, value AS y FROM events")
def _(t):
    return S.seasonal_overlay(t.events, "ts", "value", "weekday", E)


@query("tsa10_calendar_points", "SELECT strftime(ts, '%Y-%m-%d') AS date, round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY 1")
def _(t):
    return rounded(S.calendar_points(t.events, "ts", "value"), 6, "value").withColumn("date", F.col("date").cast("string"))


@query("tsa11_day_hour", "SELECT dayofweek(ts) AS day, hour(ts) AS hour, round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY 1, 2")
def _(t):
    return rounded(S.day_hour(t.events, "ts", "value"), 6, "value")


@query("tsa12_series_corr", "SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
def _(t):
    return rounded(S.series_corr(t.lineitem, ["l_quantity", "l_extendedprice"]), 8, "r")


@query("tsa13_series_points", "SELECT l_shipdate, l_quantity, l_discount FROM lineitem")
def _(t):
    return S.series_points(t.lineitem, "l_shipdate", ["l_quantity", "l_discount"])


@query("tsa13_series_scatter", f"SELECT id, v AS x, k::DOUBLE AS y FROM {SRC} WHERE v IS NOT NULL AND k IS NOT NULL")
def _(t):
    return S.series_scatter(src(t), "v", "k", ["id"])

"""Filters, projections, joins, text and sources on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from planlens.functions import parse, tails, text
from planlens.operators import aggregate as A
from planlens.operators import association as S
from planlens.operators import charts as C
from planlens.operators import joins as J
from planlens.operators import predicates as P
from planlens.operators import projection as R
from planlens.operators import ranking as K
from planlens.sources import readers, sinks


def ids(df):
    return sorted(r.i for r in df.collect())


def test_number_filter_never_matches_null(column):
    d = column([1.0, None, 3.0])
    assert ids(P.apply_filters(d, {"v": {"type": "number", "operator": "<", "value": 5}})) == [0, 2]
    assert ids(P.apply_filters(d, {"v": {"type": "number", "operator": "isNull"}})) == [1]
    assert ids(P.apply_filters(d, {"v": {"type": "number", "operator": "between", "valueFrom": 2, "valueTo": None}})) == []


def test_text_filters(column):
    d = column(["a_b", "axb", "", None, "A_B"], "string")
    f = lambda op, v=None, **k: ids(P.apply_filters(d, {"v": {"type": "string", "operator": op, "value": v}}, **k))
    assert f("ilike", "a_b") == [0, 4]                      # _ is a plain character
    assert f("ilike", "%B") == [0, 1, 4]
    assert f("ilike", "x") == [] and f("ilike", "x", contains=True) == [1]
    assert f("isNull") == [2, 3] and f("isNotNull") == [0, 1, 4]
    assert f("categoryNotEquals", "axb") == [0, 2, 4]       # null fails
    two = {"v": {"type": "string", "operator": "categoryEquals", "value": "a_b"}, "v__dup__1": {"type": "string", "operator": "categoryEquals", "value": "axb"}}
    assert ids(P.apply_filters(d, two)) == [0, 1]


def test_datetime_equality_is_to_the_minute(column):
    d = column(["2024-01-01 10:00:59", "2024-01-01T10:01:00", "bad"], "string")
    assert ids(P.apply_filters(d, {"v": {"type": "datetime", "operator": "==", "value": "2024-01-01 10:00:05"}})) == [0]


def test_date_filter_on_timestamps_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT timestamp_ntz'2024-01-01 23:59:59' AS ts, 0 AS i UNION ALL SELECT timestamp_ntz'2024-01-02 00:00:00', 1").write.parquet(path)
    d = P.apply_filters(spark.read.parquet(path), {"ts": {"type": "date", "operator": ">", "value": "2024-01-01"}})
    assert ids(d) == [1]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in d._jdf.queryExecution().toString()


def test_multi_value(column):
    d = column(["a | B", "b2", None], "string")
    assert ids(d.filter(P.has_part("v", r"\|", "b"))) == [0]
    assert ids(d.filter(P.lacks_part("v", r"\|", "b"))) == [1, 2]


def test_calculated_field(spark, read):
    d = spark.createDataFrame([(0, 6.0, 2.0), (1, None, 2.0), (2, 1.0, 0.0)], "i int, a double, ab double")
    assert read(R.with_calculated(d, "x", "ab * 2 + a / ab"), "x") == [7, 4, None]
    with pytest.raises(ValueError):
        R.with_calculated(d, "x", "a ** 2")
    with pytest.raises(ValueError):
        R.with_calculated(d, "x", "__import__")


def test_star_join_needs_a_common_key(spark):
    a = spark.createDataFrame([(1, 2)], "hadm_id int, subject_id int")
    b = spark.createDataFrame([(1, 9)], "hadm_id int, x int")
    assert J.star_join({"a": a, "b": b}, ["stay_id", "hadm_id"]).columns == ["a.hadm_id", "a.subject_id", "b.hadm_id", "b.x"]
    with pytest.raises(ValueError):
        J.star_join({"a": a, "c": spark.createDataFrame([(1,)], "z int")}, ["hadm_id"])


def test_first_record_puts_null_last(spark):
    d = spark.createDataFrame([(1, None, 10), (1, 5, 11), (2, None, 12)], "s int, t int, i int")
    assert ids(J.first_per_subject(d, "s", ["t", "i"])) == [11, 12]


def test_group_aliases(spark):
    d = spark.createDataFrame([("1", "ГБУ «Первая»", ["дом"], ["Санаторий"]), ("2", "Вторая", ["дом"], ["Санаторий"]), ("3", "Третья", [], [])],
                              "oid string, name string, aliases array<string>, groups array<string>")
    q = spark.createDataFrame([("первая",), ("Дом",), ("санаторий",), ("нет",)], "n string")
    out = J.resolve_groups(q, d, "n", "oid", F.concat(F.array("name"), F.col("aliases")), F.col("groups"), lambda c: text.name_variants(c, ["тестовой области"]))
    assert {r.n: (r.match, r.resolved_id) for r in out.collect()} == {"первая": ("single", "1"), "Дом": ("ambiguous", None), "санаторий": ("group", None), "нет": ("none", None)}


def test_grid_refuses_instead_of_cutting(spark):
    with pytest.raises(Exception, match="more than 2 distinct"):
        J.grid(spark.range(1).toDF("o"), spark.range(3).toDF("t"), "t", max_types=2).collect()


def test_min_max_fall_back_to_text(spark):
    d = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "10"), ("b", "9")], "x string, y string")
    assert {r._x: r.y for r in C.chart_aggregate(d, "x", ["y"], "min").collect()} == {"a": "a", "b": "9.0"}


def test_histogram_of_one_value(column):
    assert [tuple(r) for r in C.histogram(column([4.0, 4.0]), "v").collect()] == [(0, 4.0, 4.0, 2)]


def test_duplicates_counts_both_ways(spark):
    d = spark.createDataFrame([(1,), (1,), (1,), (2,)], "a int")
    assert tuple(A.duplicates(d).head()) == (3, 2)


def test_numerator_rule_by_date():
    rules = [{"from": "2024-01-01", "rule": "sum"}, {"from": "2027-01-01", "rule": "max"}]
    assert [A.rule_at(rules, d) for d in ("2026-12-31", "2027-01-01")] == ["sum", "max"]


def test_systematic_sample(spark):
    assert sorted(r.id for r in K.systematic_sample(spark.range(10), 3, ["id"]).collect()) == [0, 4, 8]


@pytest.mark.parametrize("raw,want", [("1 234,5", 1234.5), ("-3.", -3.0), ("1d", None), ("", None), ("1e3", 1000.0)])
def test_parse_number(column, read, raw, want):
    assert read(column([raw], "string").withColumn("v", parse.parse_number(F.col("v")))) == [want]


def test_parse_dates_and_times(column, read):
    d = column(["2024-02-03", "03.02.2024", "3.2.2024", "02/13/2024", "2024-02-03 04:05", "12:30", "junk", "Sat, 03 Feb 2024 04:05:06 +0000"], "string")
    assert [str(x) for x in read(d.withColumn("v", parse.parse_date(F.col("v"))))] == ["2024-02-03"] * 3 + ["2024-02-13", "2024-02-03", "None", "None", "2024-02-03"]
    assert read(d.withColumn("v", parse.classify(F.col("v")))) == ["date"] * 4 + ["datetime", "time", None, "datetime"]
    t = column(["9:05", "12:15 AM", "1:00 pm", "25:00"], "string")
    assert read(t.withColumn("v", parse.parse_time(F.col("v")))) == ["09:05:00", "00:15:00", "13:00:00", "25:00"]


def test_text_keys(column, read):
    d = column(["Рецепт №107-1/у «Ёж»"], "string")
    assert read(d.withColumn("v", text.name_key(F.col("v")))) == ["рецепт_107_1_у_еж"]
    assert read(d.withColumn("v", text.strip_version(F.lit("Эпикриз (CDA) Редакция 3")))) == ["Эпикриз"]
    assert read(d.withColumn("v", text.section_code(F.lit(" 3.2 Осмотры")))) == ["3.2"]
    a = column(["45", "> 89", "", "x"], "string")
    assert read(a.withColumn("v", text.parse_age(F.col("v")))) == [45, 90, None, None]


def test_tails_against_known_values():
    close = lambda a, b: abs(a - b) < 1e-6
    assert close(tails.normal_two_sided(1.959964), 0.05)
    assert close(tails.chi2_upper(5.991465, 2), 0.05) and close(tails.chi2_upper(3.841459, 1), 0.05)
    assert close(tails.t_two_sided(2.228139, 10), 0.05) and close(tails.f_upper(4.102821, 2, 10), 0.05)
    assert close(tails.fisher_2x2(3, 4, 4, 8), 0.485714) and math.isclose(tails.corr_two_sided(1.0, 10), 0.0)


def test_kendall_exact_against_all_pairs(spark):
    rows = [((i * 7) % 13, (i * 11) % 9) for i in range(60)]
    k = S.kendall(spark.createDataFrame(rows, "a int, b int"), "a", "b").head()
    con = dis = ta = tb = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[i + 1:]:
            if a != c and b != d:
                con, dis = con + ((a - c) * (b - d) > 0), dis + ((a - c) * (b - d) < 0)
            ta, tb = ta + (a == c and b != d), tb + (b == d and a != c)
    assert (k.concordant, k.discordant, k.ties_a, k.ties_b) == (con, dis, ta, tb)


def test_kendall_over_strips_against_all_pairs(spark, monkeypatch):
    """Several strips, a value that fills one of its own, nulls and two pairs; rows used to be written once for every bit of a rank."""
    import random
    import numpy as np
    monkeypatch.setattr(S, "STRIP", 8)
    r = random.Random(5)
    rows = [(r.choice([r.gauss(0, 1), 0.25, 0.25]), r.choice([r.gauss(0, 1), -0.5, None]), float(r.randrange(400))) for _ in range(900)]
    out = S.kendall_pairs(spark.createDataFrame(rows, "a double, b double, c double"), [("a", "b"), ("c", "a")])
    got = {(k.col_a, k.col_b): (k.n_used, k.concordant, k.discordant) for k in out.collect()}
    for i, j, names in ((0, 1, ("a", "b")), (2, 0, ("c", "a"))):
        x, y = (np.array([p[k] for p in rows if p[i] is not None and p[j] is not None]) for k in (i, j))
        signs = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
        assert got[names] == (len(x), (signs > 0).sum() / 2, (signs < 0).sum() / 2)
    assert len(S._strips(spark.createDataFrame(rows, "a double, b double, c double"), ["c"])["c"][0]) > 3
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_fisher_on_small_table(spark):
    d = spark.createDataFrame([("a", "x")] * 3 + [("a", "y")] + [("b", "x")] + [("b", "y")] * 3, "p string, q string")
    r = S.chi2_or_fisher(d, [("p", "q")]).head()
    assert r.test == "Fisher" and abs(r.p_value - 0.485714) < 1e-6 and abs(r.stat - 2.0) < 1e-9


def test_csv_roundtrip_types_and_ragged_lines(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,c\n1,x,2.5\n2,,3,extra\n3,y\n")
    d = readers.read_csv(spark, str(p))
    assert dict(d.dtypes) == {"a": "bigint", "b": "string", "c": "double"}
    assert [tuple(r) for r in d.orderBy("a").collect()] == [(1, "x", 2.5), (2, None, 3.0), (3, "y", None)]
    assert readers.route("a/b.PARQUET") == "parquet" and readers.route("blob", "text/csv; charset=x") == "csv" and readers.route("blob") == "csv"


def test_detected_types(spark):
    d = spark.createDataFrame([("1,5", "2024-01-01", "2024-01-01 10:00", "10:00", "a")] * 3 + [("", "", "", "", "")], "n string, d string, t string, h string, s string")
    assert list(readers.detect_types(d).values()) == ["number", "date", "datetime", "time", "string"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("p1", "a", 1), ("p2", "a", 2)], "period_id string, k string, n int")
    path = str(tmp_path / "facts")
    sinks.load_facts(d, path, ["period_id", "k"], "replace")
    sinks.load_facts(spark.createDataFrame([("p1", "b", 5), ("p1", "a", 9)], d.schema), path, ["period_id", "k"], "merge")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("period_id", "k", "n").collect()) == [("p1", "a", 9), ("p1", "b", 5), ("p2", "a", 2)]
    sinks.load_facts(spark.createDataFrame([("p1", "c", 7)], d.schema), path, ["period_id", "k"], "replace")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("period_id", "k", "n").collect()) == [("p1", "c", 7), ("p2", "a", 2)]
    with pytest.raises(ValueError):
        sinks.clean_formats(["xlsx"])
    assert sinks.clean_formats([" CSV", "csv"]) == ["csv"] and sinks.clean_formats(None) == ["parquet"]


def test_csv_keeps_cells_after_the_first_ten_thousand(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(12_000)) + "late text,1.5\n")
    d = readers.read_csv(spark, str(p))
    assert dict(d.dtypes) == {"a": "string", "b": "double"}
    assert d.filter("a = 'late text' and b = 1.5").count() == 1 and d.filter("a is null or b is null").count() == 0
    raw = readers.read_text_csv(spark, str(p))
    assert readers.detect_types(raw) == {"a": "string", "b": "number"}
    assert readers.misfits(raw, {"a": "number", "b": "number"}) == {"a": 1, "b": 0}


def test_formula_with_numeric_and_nested_names(spark):
    from planlens.operators.projection import with_calculated
    d = spark.createDataFrame([(3.0, 5.0, 7.0)], ["ab", "0", "a"])
    assert with_calculated(d, "r", "ab*2 + 10 - a").head().r == 9.0
    assert with_calculated(d, "r", "ab + 0").head().r == 8.0


def test_waterfall_in_another_order(spark):
    from planlens.operators.charts import waterfall
    d = spark.createDataFrame([("a", 1.0, 3), ("b", 2.0, 1), ("c", -4.0, 2), ("a", 1.0, 9)], "x string, v double, o int")
    assert [tuple(r) for r in waterfall(d, "x", "v", "sum", order="o").orderBy("total").select("_x", "total").collect()] == [("c", -2.0), ("a", 0.0), ("b", 2.0)]


def test_merges_stage_under_names_of_their_own(spark, tmp_path):
    from planlens.sources import sinks
    path = str(tmp_path / "facts")
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "period_id int, k string, n int")
    sinks.load_facts(one, path, ["k"], "replace")
    sinks.load_facts(one.filter("k = 'a'").withColumn("n", one.n + 9), path, ["k"])
    assert {(r.k, r.n) for r in spark.read.parquet(path).collect()} == {("a", 10), ("b", 2)}
    assert [p.name for p in tmp_path.iterdir()] == ["facts"]



def test_charts_and_lists_show_all_rows(spark):
    from planlens.operators import aggregate, charts
    d = spark.range(6000).selectExpr("id", "id as v")
    assert charts.scatter(d, "id", ["v"], ["id"]).count() == charts.bubble(d, "id", "v", ["id"]).count() == 6000
    assert charts.scatter(d, "id", ["v"], ["id"], limit=10).count() == 10
    assert aggregate.distinct_values(d, "id").count() == 6000 and aggregate.distinct_values(d, "id", 3).count() == 3
    assert tuple(aggregate.capped_count(d).head()) == (6000, False) and tuple(aggregate.capped_count(d, 10).head()) == (10, True)


def test_fisher_exact_stays_fisher_on_large_tables(spark):
    d = spark.range(400).select((F.col("id") % 2 == 0).alias("p"), (F.col("id") % 8 < 4).alias("q"))  # every expected count is 100
    assert S.chi2_or_fisher(d, [("p", "q")]).head().test == "chi2"
    r = S.fisher_exact(d, [("p", "q")]).head()
    assert (r.test, r.n) == ("Fisher", 400) and math.isclose(r.p_value, 1.0, rel_tol=1e-9)


SHAPED = ["2020-01-02", "+12345-01-02", "-2020-01-02", "02.01.2020", "2.1.2020", "002.01.2020", "2/1/2020", "13/12/2020", "12-13-2020", "2020.01.02", "2020-01-02 03:04:05", "2020-01-02T03:04", "2020-01-02t03:04:05",
          "2020-01-02T03:04:05Z", "2020-01-02T03:04:05z", "2020-01-02T03:04:05+03:00", "02.01.2020 03:04", "02/01/2020 03:04:05", "2020-01-02 03:04:05.6", "2020-13-02", "31.02.2020", "02.01.20", "x", "1.5", "1e5", "5-LOW", "",
          " 7", "7 ", "+7", "-7", "7.", ".7", "7d", "7F", "0x1p3", "NaN", "-inf", "Infinity", "+Infinity", "true", "T", "yes", " no ", "0", "truex", "1998-09-27T00:00:00.000", "99999999999999999999", "\t8\n", "--1", "1 2"]


def test_shape_checks_keep_every_text_that_parses(spark):
    d = spark.createDataFrame([(v,) for v in SHAPED], "v string")
    for fmt in [*parse.DATE_FORMATS, *parse.DATETIME_FORMATS]:
        odd = d.filter(~F.try_to_timestamp("v", F.lit(fmt)).eqNullSafe(parse._timestamp(F.col("v"), fmt)) | (F.try_to_timestamp("v", F.lit(fmt)).isNotNull() & ~F.col("v").rlike(parse.TEMPORAL)))
        assert odd.collect() == [], fmt
    for kind in readers.FITTING:
        plain, checked = F.col("v").try_cast(kind).cast("string"), readers.fitting(F.col("v"), kind).cast("string")
        assert d.filter(~plain.eqNullSafe(checked)).collect() == [], kind
    assert not d.filter(F.col("v") == "5-LOW").filter(F.col("v").rlike(parse.shape("yyyy-MM-dd")) | F.col("v").rlike(readers.FITTING["double"])).collect()

"""Indicator rules on literal facts and plans."""

import datetime

import pytest
from pyspark.sql import functions as F

from planlens.operators import joins as J
from planlens.plans import applicability as A
from planlens.plans import coverage as V
from planlens.plans import indicators as I
from planlens.plans import registers as G
from planlens.plans import series as M

SUM = {"indicator_id": "s", "types": ["37", "119"], "aggregate": "sum", "sheets": ["2", "3"]}
MAX = {"indicator_id": "m", "types": ["340", "141"], "aggregate": "max", "additional": ["551"], "sheets": ["4"]}


@pytest.fixture(scope="module")
def inputs(spark):
    facts = spark.createDataFrame([("p", "a", "37", 10), ("p", "a", "37", 5), ("p", "a", "119", 1), ("p", "x", "37", 99), ("p", "b", "340", 7), ("p", "b", "141", 9), ("p", "b", "551", 2)],
                                  "period_id string, organization_oid string, type_code string, document_count long")
    plans = spark.createDataFrame([("p", "a", "2", 120.0, {1: 10.0, 2: 10.0, 12: 100.0, 13: 5.0}), ("p", "a", "3", 12.0, {}), ("p", "c", "2", 0.0, {})],
                                  "period_id string, organization_oid string, sheet_code string, annual_value double, monthly_values map<int,double>")
    targets = spark.createDataFrame([("p", o, 2) for o in "abc"], "period_id string, organization_oid string, through_month int")
    return facts, plans, targets


def test_plan_ratio_statuses(inputs):
    rows = {(r.indicator_id, r.organization_oid): r for r in I.plan_ratio(*inputs, [SUM, MAX]).collect()}
    a = rows["s", "a"]
    assert (a.status, a.numerator, a.denominator, a.annual_denominator, a.used_annual_fallback, a.percent) == ("calculated", 16, 32, 132, True, 50.0)
    b = rows["m", "b"]
    assert (b.status, b.numerator, b.denominator, b.percent) == ("no_approved_volume", 11, None, None)
    assert rows["s", "c"].status == "not_participating"
    assert {k for k in rows} == {(i, o) for i in "sm" for o in "abc"}
    region = {r.indicator_id: r for r in I.plan_ratio_region(I.plan_ratio(*inputs, [SUM, MAX])).collect()}
    assert (region["m"].numerator_without_plan, region["m"].percent, region["s"].calculated) == (11, None, 1)


def test_year_volume_in_december_is_a_dash_not_zero(spark, inputs):
    plans = spark.createDataFrame([("p", "a", "2", 100.0, {12: 100.0})], inputs[1].schema)
    r = I.plan_ratio(inputs[0], plans, inputs[2], [SUM]).filter("organization_oid = 'a'").head()
    assert (r.status, r.denominator, r.percent) == ("calculated", 0.0, None)


def test_ratio_percent_edges(spark):
    rows = [(1.0, 3.0, 33.33, "ok"), (1.0, 0.0, 5.0, "ok"), (None, 2.0, 5.0, "ok"), (1.0, 2.0, 60.0, "ok"), (1.0, 2.0, 50.01, "ok"), (1.0, 2.0, None, "ok"), (1.0, 2.0, 5.0, "in_development")]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, numerator double, denominator double, target_value double, methodology_status string")
    out = [(r.status, r.business_status) for r in I.ratio_percent(d).orderBy("i").collect()]
    assert out == [("calculated", "target_met"), ("awaiting_data", "not_assessed"), ("awaiting_data", "not_assessed"), ("calculated", "critical"), ("calculated", "below_target"),
                   ("calculated", "not_assessed"), ("methodology_in_development", "not_assessed")]


def test_monthly_null_against_zero(spark, inputs):
    facts = inputs[0].withColumn("month", F.lit(1))
    loaded = spark.createDataFrame([("p", 1), ("p", 2)], "period_id string, month int")
    s = {(r.indicator_id, r.month): r for r in M.monthly_series(facts, inputs[1], inputs[2], [SUM, MAX], loaded).collect()}
    assert len(s) == 24
    assert (s["s", 1].fact, s["s", 1].plan, s["s", 1].ratio) == (16, 10, 160.0)
    assert (s["s", 2].fact, s["s", 3].fact, s["s", 3].plan) == (0, None, 0)
    assert s["m", 1].plan is None and s["m", 1].ratio is None


def test_months_of_organizations_meet_in_one_aggregation(spark, inputs):
    """Each join hashed or sorted the table once more in one task; missing keys meet nobody, slices may overlap."""
    n = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        facts = inputs[0].unionByName(spark.createDataFrame([("p", None, "37", 8)], inputs[0].schema)).withColumn("month", F.lit(1))
        targets = inputs[2].unionByName(spark.createDataFrame([("p", None, 2)], inputs[2].schema))
        loaded = spark.createDataFrame([("p", 1), ("p", 2)], "period_id string, month int")
        args = facts, inputs[1], targets, [SUM, MAX], loaded, True
        series = M.monthly_series(*args)
        plan = series._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        s = {(r.indicator_id, r.organization_oid, r.month): (r.plan, r.fact, r.ratio) for r in series.collect()}
        assert len(s) == 2 * 4 * 12
        assert s["s", "a", 1] == (10, 16, 160) and s["s", "a", 12] == (100, None, None) and s["m", "b", 1] == (None, 11, None) and s["s", None, 1] == (None, 0, None)
        slices = spark.createDataFrame([("p", "s", 1, 2), ("p", "s", 1, 1), ("p", "m", 5, 4)], "period_id string, indicator_id string, from_month int, to_month int")
        case = spark.createDataFrame([("p", "s", "a", 8.0)], "period_id string, indicator_id string, organization_oid string, case_fact double")
        of = [{(r.indicator_id, r.organization_oid): r[3:] for r in M.org_breakdown(p, case, slices).collect()} for p in (series, M.monthly_table(*args))]
        assert of[0] == of[1] and of[0]["s", "a"] == ([160, 0, *[None] * 10], 8, 32, 400) and of[0]["m", "b"] == ([None] * 12, None, None, None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", n)


def test_registry_series_is_not_grouped_by_organization(spark):
    from planlens.catalog import QUERIES
    plan = QUERIES["ind12_registry_series"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert keys and not any("organization" in k or "type" in k for k in keys)


def points(spark, facts, plan=100.0):
    return spark.createDataFrame([("p", "i", m, plan, float(f) if f is not None else None, None) for m, f in zip(range(1, 13), facts + [None] * (12 - len(facts)))],
                                 "period_id string, indicator_id string, month int, plan double, fact double, ratio double")


def test_forecast_and_verdicts(spark):
    p = points(spark, [50, 60, 70])
    f = M.forecast(p).head()
    assert (f.year_plan, f.fact_to_date, f.best_month, f.months_left, f.ceiling, f.achievable, f.required_per_month) == (1200, 180, 3, 9, 810, False, 114)
    assert M.verdict(M.forecast(p), M.anomalies(p)).head().verdict == "unreachable"
    even = points(spark, [110, 110, 110])
    assert M.verdict(M.forecast(even), M.anomalies(even)).head().verdict == "on_track"
    assert M.forecast(points(spark, [])).count() == 0


def test_anomaly_rules(spark):
    found = {r.code: r for r in M.anomalies(points(spark, [100, 130, 60, 90, 20])).collect()}
    assert (found["spike_and_drop"].month, found["spike_and_drop"].other_month, found["spike_and_drop"].base) == (2, 3, 30.0)  # the last month is partial
    assert "flat_plan" in found
    assert {r.code for r in M.anomalies(points(spark, [200, 100, 100])).collect()} >= {"january_tail"}


def test_type_coverage_is_distinct_at_each_level(spark):
    facts = spark.createDataFrame([("p", "a", "1", 5), ("p", "b", "1", 5), ("p", "a", "9", 1), ("p", "a", "2", 0)], "period_id string, organization_oid string, type_id string, document_count long")
    reg = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "type_id string")
    targets = spark.createDataFrame([("p", o) for o in "abc"], "period_id string, organization_oid string")
    req = spark.createDataFrame([("p", "a", "1", "required"), ("p", "a", "2", "required"), ("p", "b", "3", "unknown"), ("p", "b", "9", "required")], "period_id string, organization_oid string, type_id string, status string")
    org = {r.organization_oid: r for r in I.type_coverage(facts, reg, targets, req).collect()}
    assert (org["a"].registered_types, org["a"].types_outside_registry, org["a"].plan_percent, org["b"].required_types, org["b"].undefined_types) == (2, 1, 50.0, 0, 1)
    region = I.type_coverage_region(facts, reg, targets, req, count_outside=False).head()
    assert (region.registered_types, region.percent, region.organizations_without_registration, region.required_types) == (1, 25.0, 1, 2)


@pytest.mark.parametrize("req,reg,avail,want", [("required", True, None, "required_registered"), ("required", False, False, "required_unavailable"), ("required", False, True, "required_missing"),
                                                ("required", False, None, "required_unknown"), ("not_required", True, None, "not_required_registered"), ("not_required", False, None, "not_required"),
                                                ("missing", True, None, "unknown_registered"), ("unknown", False, True, "unknown")])
def test_pair_status(spark, req, reg, avail, want):
    d = spark.createDataFrame([(req, reg, avail)], "q string, r boolean, a boolean")
    assert d.select(V.pair_status(F.col("q"), F.col("r"), F.col("a")).alias("s")).head().s == want


def test_readiness_order(spark):
    d = spark.createDataFrame([(5, 0, 3, False), (0, 0, 0, True), (5, 5, 0, True), (5, 1, 3, True), (5, 0, 0, True), (5, 0, 3, True)], "c int, u int, a int, d boolean")
    got = [r.s for r in d.select(V.readiness_state(F.col("c"), F.col("u"), F.col("a"), F.col("d")).alias("s")).collect()]
    assert got == ["data_missing", "reference_missing", "reference_missing", "reference_incomplete", "reference_empty", "ready"]


def test_interval_classes(spark):
    D = datetime.date
    rows = [(D(2026, 1, 1), D(2026, 1, 31)), (D(2026, 1, 1), D(2026, 6, 30)), (D(2026, 3, 1), D(2026, 6, 30)), (D(2025, 12, 1), D(2026, 1, 31)), (D(2026, 4, 2), D(2026, 4, 30))]
    out = G.interval_class(spark.createDataFrame(rows, "from_date date, to_date date")).orderBy("from_date", "to_date").collect()
    assert [(r.coverage, r.month) for r in out] == [(None, None), ("month", 1), ("cumulative", 6), (None, None), (None, None)]


def test_plan_rule_and_conditions(spark):
    orgs = spark.createDataFrame([("a",), ("b",), ("c",)], "organization_oid string")
    plan = spark.createDataFrame([("a", "3.2", 5.0), ("b", "3.2", 0.0)], "organization_oid string, sheet_code string, annual_value double")
    pr = spark.createDataFrame([("t", "3.2", True)], "type_id string, sheet_code string, zero_means_not_required boolean")
    assert {r.organization_oid: r.plan_status for r in A.plan_rule(orgs, plan, pr).collect()} == {"a": "required", "b": "not_required"}
    rules = spark.createDataFrame([(1, "t", "required", "", "", "none", False, False, False, [2]), (2, "u", "required", "", "", "inpatient_or_day_hospital", False, False, False, [1]),
                                   (3, "w", "required", "", "", "listed", True, True, False, [1])],
                                  "rule_id int, type_id string, requirement_status string, subdivision_type string, subdivision_kind string, condition_code string, excludes boolean, has_list boolean, from_directory boolean, grounds array<int>")
    subs = spark.createDataFrame([("a", "Стационарный", "", ""), ("b", "Амбулаторный", "дневной стационар", "")], "organization_oid string, subdivision_type string, subdivision_kind string, name string")
    lists = spark.createDataFrame([(3, "a")], "rule_id int, organization_oid string")
    v = {(r.rule_id, r.organization_oid): (r.verdict, r.plan_absent) for r in A.rule_verdicts(rules, orgs, subs, lists, plan, pr).collect()}
    assert [v[1, o] for o in "abc"] == [("matched", False), ("not_matched", False), ("not_matched", True)]
    assert [v[2, o][0] for o in "abc"] == ["matched", "matched", "not_matched"]
    assert [v[3, o][0] for o in "abc"] == ["not_matched", "matched", "matched"]
    types = spark.createDataFrame([("t",), ("u",), ("w",), ("z",)], "type_id string")
    hits = A.rule_hits(rules, orgs, subs, lists, plan, pr)
    assert {(r.rule_id, r.organization_oid): r.verdict for r in hits.collect()} == {k: x for k, (x, _) in v.items() if x != "not_matched"}
    out = {(r.type_id, r.organization_oid): r for r in A.applicability(types, orgs, rules, hits, plan, pr).collect()}
    assert out["t", "a"].requirement_status == "required" and out["t", "c"].waived and out["z", "a"].missing_rule


def test_hits_are_the_decided_pairs(spark):
    """Every condition, pattern, ground and list against the listing of all pairs, with nulls and unknown organizations; more rules than that listing takes."""
    import itertools
    import random
    from planlens.plans import applicability as A
    r = random.Random(4)
    orgs = spark.createDataFrame([(f"o{i}",) for i in range(12)], "organization_oid string")
    codes = ["none", "custom", "inpatient_or_day_hospital", "day_hospital_group", "licensed", None]
    kinds = ["", "Стационарный", "дневной стационар", None]
    cases = itertools.product(codes, kinds, kinds, [True, False, None], [True, False], [True, False], [[2], [1], None])
    rules = [(i, f"t{i % 7}", r.choice(["required", "unknown", "not_required"]), t, k, c, e, h, d, g) for i, (c, t, k, e, h, d, g) in enumerate(cases)]
    schema = "rule_id int, type_id string, requirement_status string, subdivision_type string, subdivision_kind string, condition_code string, excludes boolean, has_list boolean, from_directory boolean, grounds array<int>"
    subs = spark.createDataFrame([(f"o{r.randrange(14)}", r.choice(kinds), r.choice(kinds), r.choice(["x", "дневной стационар", None])) for _ in range(20)], "organization_oid string, subdivision_type string, subdivision_kind string, name string")
    lists = spark.createDataFrame([(r.randrange(len(rules) + 5), f"o{r.randrange(14)}") for _ in range(2500)], "rule_id int, organization_oid string")
    plan = spark.createDataFrame([(f"o{r.randrange(9)}", f"s{r.randrange(5)}", r.choice([0.0, 5.0, None])) for _ in range(25)], "organization_oid string, sheet_code string, annual_value double")
    plan_rules = spark.createDataFrame([(f"t{i}", f"s{i % 5}", i % 2 == 0) for i in range(5)], "type_id string, sheet_code string, zero_means_not_required boolean")
    table = spark.createDataFrame(rules, schema)
    rest = (orgs, subs, lists, plan, plan_rules)
    pairs = A.rule_verdicts(table, *rest).collect()
    hits = A.rule_hits(table, *rest)
    got = sorted((x.rule_id, x.organization_oid, x.verdict) for x in hits.collect())
    assert got == sorted((x.rule_id, x.organization_oid, x.verdict) for x in pairs if x.verdict != "not_matched") and {x[2] for x in got} == {"matched", "unknown"}
    out = A.applicability(spark.createDataFrame([(f"t{i}",) for i in range(9)], "type_id string"), orgs, table, hits, plan, plan_rules).collect()
    assert len(out) == 12 * 9
    for x in out:
        mine = [p for p in pairs if (p.organization_oid, p.type_id) == (x.organization_oid, x.type_id)]
        matched = [p for p in mine if p.verdict == "matched"]
        want = "unknown" if not mine else "required" if any(p.requirement_status == "required" for p in matched) else "unknown" if any(p.verdict == "unknown" or (p.verdict == "matched" and p.requirement_status == "unknown") for p in mine) else "not_required"
        assert (x.requirement_status, x.missing_rule) == (want, not mine)
        assert x.waived == (want == "not_required" and any(p.plan_absent for p in mine))
    many = spark.range(10_001).select(F.col("id").cast("int").alias("rule_id"), F.lit("t1").alias("type_id"), F.lit("required").alias("requirement_status"), F.concat(F.lit("k"), F.col("id")).alias("subdivision_type"), F.lit("").alias("subdivision_kind"),
                                      F.lit("none").alias("condition_code"), F.lit(False).alias("excludes"), F.lit(False).alias("has_list"), F.lit(False).alias("from_directory"), F.array(F.lit(1)).alias("grounds"))
    one = spark.createDataFrame([("o1", "K77", "", "")], subs.schema)
    assert [(x.rule_id, x.organization_oid) for x in A.rule_hits(many, orgs, one, lists.limit(0), plan.limit(0), plan_rules).collect()] == [(77, "o1")]


def test_condition_text(spark):
    d = spark.createDataFrame([("Обязателен (строка 28: Амбулаторный · население; строка 29: x).",), ("Required (row 3)",), (None,), ("Required (row 3: day ward (adults)).",)], "r string")
    assert [r.c for r in d.select(G.stated_condition(F.col("r")).alias("c")).collect()] == ["Амбулаторный · население", "unconditional", "unconditional", "day ward (adults)"]


def test_gap_summary(spark):
    rows = [("p", "i", "1", "A", "calculated", 0.0, 80.0), ("p", "i", "2", "B", "calculated", 10.0, 25.0), ("p", "i", "3", "C", "calculated", 30.0, 10.0), ("p", "i", "4", "D", "no_approved_volume", 7.0, None)]
    s = M.gap_summary(spark.createDataFrame(rows, "period_id string, indicator_id string, organization_oid string, organization_name string, status string, numerator double, denominator double")).head()
    assert (s.total_gap, s.organizations_to_close, s.fact_without_plan, s.calculated) == (95, 1, 7, 3)


def test_deviation_ties_go_up(spark):
    from planlens.plans.indicators import assess
    d = spark.createDataFrame([(10.0, 10.125), (10.125, 10.0)], "fact_value double, target_value double")
    assert [r.deviation_value for r in assess(d).collect()] == [-0.12, 0.13]


def test_sides_that_explode_are_not_broadcast(spark):
    """Planned sizes do not count what a grid multiplies: its rows met the pairs through a broadcast from the driver."""
    n = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        orgs = spark.range(50).select(F.lit("p").alias("period_id"), F.col("id").alias("organization_oid"))
        types = spark.range(8).select(F.col("id").alias("type_id"), F.lit(True).alias("in_reference"), F.lit(True).alias("registry_visible"), F.lit(True).alias("reference_visible"))
        facts = orgs.select("*", F.lit("organization").alias("scope_level"), (F.col("organization_oid") % 8).alias("type_id"), F.lit(1).alias("document_count"), F.lit(1).alias("month"))
        required = J.grid(orgs, types, "type_id").select("*", F.lit("required").alias("requirement_status"), F.lit(True).alias("available"), F.lit(False).alias("is_manual"))
        pairs = V.classify_pairs(types, facts, orgs, required)
        series = M.registry_series(facts, J.grid(spark.range(50).select(F.col("id").alias("organization_oid")), orgs, "period_id"), facts)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
        assert "ShuffledHashJoin" in series._jdf.queryExecution().executedPlan().toString()
        assert pairs.groupBy("pair_status").count().orderBy("pair_status").collect() == [("required_missing", 350), ("required_registered", 50)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", n)


def test_types_outside_the_config_leave_before_the_aggregation(spark, inputs):
    facts, plans, targets = inputs
    counted = facts.groupBy("period_id", "organization_oid", "type_code").agg(F.sum("document_count").alias("document_count"))
    plan = I.numerators(counted, [SUM, MAX])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("type_code#", 0, plan.rindex("Filter")) < plan.rindex("Filter") and " IN (" in plan[plan.rindex("Filter"):] and plan.rindex("Filter") > plan.rindex("Aggregate")
    assert I.numerators(facts, [SUM, MAX]).count() == 3


def test_listing_of_all_pairs_moves_blocks_of_rules(spark):
    """Against each pair decided on its own: rules that repeat a rule_id, more of them than a block has, an organization without a key."""
    import itertools
    import random
    from planlens.plans import applicability as A
    r = random.Random(8)
    names = [*(f"o{i}" for i in range(7)), None]
    text = ["", "A", "b"]
    cases = list(itertools.product(["none", "custom", "listed", "empty"], text, text, [True, False], [[2], [1]]))
    rules = [(i // 2, f"t{i % 5}", "required", t, k, c, e, c == "listed", False, g) for i, (c, t, k, e, g) in enumerate(cases)] * 2
    subs = [(f"o{r.randrange(6)}", r.choice(text), r.choice(text), "x") for _ in range(9)]
    lists = {(r.randrange(40), f"o{r.randrange(7)}") for _ in range(90)}
    plan = [(f"o{r.randrange(5)}", f"s{r.randrange(4)}", r.choice([0.0, 5.0])) for _ in range(9)]
    sections = [(f"t{i}", f"s{i}", i % 2 == 0) for i in range(4)]
    frames = [spark.createDataFrame(rules, "rule_id int, type_id string, requirement_status string, subdivision_type string, subdivision_kind string, condition_code string, excludes boolean, has_list boolean, from_directory boolean, grounds array<int>"),
              spark.createDataFrame([(o,) for o in names], "organization_oid string"), spark.createDataFrame(subs, "organization_oid string, subdivision_type string, subdivision_kind string, name string"),
              spark.createDataFrame(list(lists), "rule_id int, organization_oid string"), spark.createDataFrame(plan, "organization_oid string, sheet_code string, annual_value double"),
              spark.createDataFrame(sections, "type_id string, sheet_code string, zero_means_not_required boolean")]
    resolved = {i for i, _ in lists}

    def decided(o, i, t, st, sk, code, excludes, has_list, grounds):
        volumes = [v for w, sheet, v in plan for u, x, _ in sections if (w, u) == (o, t) and x == sheet]
        zero, on_plan = any(z for u, _, z in sections if u == t), grounds == [2]
        absent = on_plan and zero and o not in {w for w, *_ in plan}
        if on_plan and volumes and max(volumes) > 0:
            return "matched", absent
        held = (st, sk) == ("", "") or any(w == o and st.lower() in ("", a.lower()) and sk.lower() in ("", b.lower()) for w, a, b, _ in subs)
        if (on_plan and zero) or not held:
            return "not_matched", absent
        if code in ("none", "custom") or not has_list:
            return "matched" if code == "none" else "unknown", absent
        if i not in resolved and not excludes:
            return "unknown", absent
        return "matched" if ((i, o) in lists) != excludes else "not_matched", absent

    want = sorted((i, str(o), t, *decided(o, i, t, st, sk, c, e, h, g)) for i, t, _, st, sk, c, e, h, _, g in rules for o in names)
    out = A.rule_verdicts(*frames)
    assert sorted((x.rule_id, str(x.organization_oid), x.type_id, x.verdict, x.plan_absent) for x in out.collect()) == want
    assert {w[3] for w in want} == {"matched", "unknown", "not_matched"}
    plan_text = out._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan_text and plan_text.index("Generate inline") < plan_text.index("Join")  # pairs are formed after the last join


def test_packed_counts_are_the_counts_of_the_pairs(spark):
    """More types than a word has bits, keys that are null, facts and rules outside the targets, rules stated twice unlike."""
    import random
    r = random.Random(5)
    types = spark.createDataFrame([(f"t{i}", i % 10 != 3, r.choice([True, True, False, None]), r.choice([True, False])) for i in range(150)], "type_id string, in_reference boolean, registry_visible boolean, reference_visible boolean")
    orgs = [(p, o) for p in ("1", "2", None) for o in (*range(6), None)]
    pick = lambda: (r.choice(["1", "2", "3", None]), r.choice([*range(8), None]))
    facts = spark.createDataFrame([(*pick(), r.choice(["organization"] * 5 + ["region"]), f"t{r.randrange(155)}", r.choice([0, 1, 2, None])) for _ in range(1500)], "period_id string, organization_oid long, scope_level string, type_id string, document_count long")
    rules = {(*pick(), f"t{r.randrange(155)}", r.choice(["required"] * 3 + ["not_required", "unknown", "missing", "other", None]), r.choice([True, False, None])): r.choice([True, False, None]) for _ in range(1200)}
    rules |= {(p, o, t, "not_required", True): False for p, o, t, s, _ in list(rules)[:100] if s == "required"}
    required = spark.createDataFrame([(*k, v) for k, v in rules.items()], "period_id string, organization_oid long, type_id string, requirement_status string, available boolean, is_manual boolean").withColumn("s", F.coalesce("requirement_status", F.lit("missing"))).dropDuplicates(
        ["period_id", "organization_oid", "type_id", "s"]).drop("s").localCheckpoint()
    external = spark.createDataFrame([(f"t{i}",) for i in range(0, 150, 4)] * 2, "type_id string")
    targets = spark.createDataFrame(orgs * 2, "period_id string, organization_oid int")
    once = required.groupBy("period_id", "organization_oid", "type_id").count().filter("count > 1").drop("count")
    single = required.join(once, ["period_id", "organization_oid", "type_id"], "left_anti")
    for ext in (external, None):
        want = V.pair_counts(V.classify_pairs(types, facts, targets, single, ext))
        got = V.packed_counts(types, facts, targets, single, ext)
        assert got.schema.names == want.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 21
        twice = V.packed_counts(types, facts, targets, required, ext).drop("registered_types", "manual_overrides")
        assert sorted(map(str, twice.collect())) == sorted(map(str, V.pair_counts(V.classify_pairs(types, facts, targets, required, ext)).drop("registered_types", "manual_overrides").collect()))
    assert V.packed_counts(types.limit(0), facts, targets, required, external).count() == 0


@pytest.mark.parametrize("name", ["ind16_organization_coverage", "ind37_flags"])
def test_counts_of_organizations_join_no_pairs(spark, name):
    """Pairs met in two hash joins and three aggregations of one task, and all organizations of a period in one sort."""
    import re
    from planlens.catalog import QUERIES
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[[^\]]*organization_oid", plan) and not re.search(r"Sort \[period_id", plan[:plan.index("Subquery")])

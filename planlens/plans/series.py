"""Monthly plan / fact series, execution slices, and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import keyed, number, percent, rnd
from .indicators import KEY, ORG_KEY, _max_rule, _sheets, _type_roles, of_sheets, of_types

MONTHS = list(range(1, 13))
# fixed values: thresholds of the conclusion rules
DROP_RATIO, SPIKE_RATIO, JANUARY_TAIL_RATIO, FLAT_PLAN_SPREAD, UNEVEN_RATIO = 1.4, 1.15, 1.25, 0.01, 1.5
PERCENT_BANDS = [100, 86.9, 60, 34, 0]


def _every_month() -> Column:
    return F.explode(F.array(*[F.lit(m) for m in MONTHS]))


def monthly_series(
    facts: DataFrame, plans: DataFrame, targets: DataFrame, config: Sequence[Mapping[str, Any]], loaded: DataFrame, by_org: bool = False
) -> DataFrame:
    """Twelve rows per (period, indicator[, organization]): plan, fact, ratio.

    facts carry ``month``; loaded: period_id, month.  A month that is not loaded has a null fact, a
    loaded month without documents is 0; without any monthly plan the plan is null.  The numerator is
    taken per organization and then summed.
    """
    table = monthly_table(facts, plans, targets, config, loaded, by_org)
    return table.select(*(ORG_KEY if by_org else KEY), F.inline("months"))


def monthly_table(
    facts: DataFrame, plans: DataFrame, targets: DataFrame, config: Sequence[Mapping[str, Any]], loaded: DataFrame, by_org: bool = False
) -> DataFrame:
    """``monthly_series`` with one row per key: ``months`` holds the twelve (month, plan, fact, ratio).

    Organizations, documents and plans meet in one aggregation over their union, the months side by side.  Joined one after the
    other, each of them is hashed or sorted once more in the same task, and the exploded months twelve times as often.
    """
    spark = facts.sparkSession
    org = ["period_id", "organization_oid"]
    count = F.coalesce(number("document_count"), F.lit(0.0))
    given = [F.try_element_at("monthly_values", F.lit(m)) for m in MONTHS]
    values = [f"v{m}" for m in MONTHS]
    ids = F.array(*[F.lit(c["indicator_id"]) for c in config])
    who = targets.select(*org, F.explode(ids).alias("indicator_id"), F.lit("target").alias("part"), *[F.lit(None).cast("double").alias(v) for v in values])
    documents = of_types(facts, config).dropna(subset=org).join(_type_roles(spark, config), "type_code").groupBy(*ORG_KEY, F.col("role").alias("part"), "type_code").agg(
        *[F.sum(F.when(F.col("month") == m, count)).alias(v) for m, v in zip(MONTHS, values)]).drop("type_code")
    planned = of_sheets(plans, config).dropna(subset=org).join(_sheets(spark, config), "sheet_code").select(
        *ORG_KEY, F.lit("plan").alias("part"), *[F.when(~F.isnan(x), x).cast("double").alias(v) for x, v in zip(given, values)])
    of = lambda part, v: F.when(F.col("part") == part, F.col(v))
    sums = [x for m, v in zip(MONTHS, values) for x in (F.sum(of("main", v)).alias(f"__s{m}"), F.max(of("main", v)).alias(f"__m{m}"),
                                                        F.sum(of("additional", v)).alias(f"__a{m}"), F.sum(of("plan", v)).alias(f"__p{m}"))]
    g = who.unionByName(documents).unionByName(planned).groupBy(*ORG_KEY).agg(F.bool_or(F.col("part") == "target").alias("__target"), *sums).filter("__target")
    zero = F.lit(0.0)
    fact = {m: F.when(_max_rule(config), F.greatest(zero, F.coalesce(f"__m{m}", zero))).otherwise(F.coalesce(f"__s{m}", zero)) + F.coalesce(f"__a{m}", zero) for m in MONTHS}
    g = g.select(*ORG_KEY, *[f.alias(f"__f{m}") for m, f in fact.items()], *[f"__p{m}" for m in MONTHS])
    if not by_org:
        g = g.groupBy(*KEY).agg(*[F.sum(f"__{x}{m}").alias(f"__{x}{m}") for x in "fp" for m in MONTHS])
    j = g.join(F.broadcast(_loaded_months(loaded)), "period_id", "left")
    any_plan = F.coalesce(*[F.col(f"__p{m}") for m in MONTHS]).isNotNull()
    p = {m: F.when(any_plan, F.coalesce(f"__p{m}", zero)) for m in MONTHS}
    f = {m: F.when(F.array_contains("__loaded", m), F.col(f"__f{m}")) for m in MONTHS}
    cells = [F.struct(F.lit(m).alias("month"), p[m].alias("plan"), f[m].alias("fact"), percent(f[m], p[m]).alias("ratio")) for m in MONTHS]
    return j.select(*(ORG_KEY if by_org else KEY), F.array(*cells).alias("months"))


def _loaded_months(loaded: DataFrame) -> DataFrame:
    """One row per period with at most twelve months."""
    return loaded.filter(F.col("month").between(1, 12)).groupBy("period_id").agg(F.collect_set(F.col("month").cast("int")).alias("__loaded"))


def registry_series(facts: DataFrame, targets: DataFrame, loaded: DataFrame) -> DataFrame:
    """(period, month, fact): documents per month over the covered organizations, null where not loaded.

    facts need no aggregation by organization or type before: they are added up by month alone.
    """
    org = ["period_id", "organization_oid"]
    dense = targets.select("period_id").distinct().withColumn("month", _every_month())
    f = facts.join(keyed(targets.select(*org)), org, "left_semi").groupBy("period_id", "month").agg(F.sum("document_count").alias("n"))
    return (dense.join(f, ["period_id", "month"], "left")
            .join(loaded.select("period_id", "month", F.lit(True).alias("__l")).distinct(), ["period_id", "month"], "left")
            .select("period_id", "month", F.when(F.col("__l"), F.coalesce("n", F.lit(0))).alias("fact")))


def type_count_series(cumulative_facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(period, month, unique_types) of cumulative slices; types are counted in the slice, not added up."""
    org = ["period_id", "organization_oid"]
    return cumulative_facts.join(keyed(targets.select(*org).distinct()), org, "left_semi").groupBy("period_id", "month").agg(
        F.count_distinct("type_code").alias("unique_types"))


def execution_summary(points: DataFrame, slices: DataFrame) -> DataFrame:
    """Plan, documents and execution over the months from..to of each slice.

    slices: period_id, indicator_id, from_month, to_month, execution_fact.  ``missing_months`` lists
    months without a loaded fact.
    """
    ok = slices.filter("from_month BETWEEN 1 AND 12 AND to_month BETWEEN 1 AND 12 AND from_month <= to_month")
    j = points.join(ok, KEY).filter("month BETWEEN from_month AND to_month")
    g = j.groupBy(*KEY, "from_month", "to_month", "execution_fact").agg(
        F.sum(F.coalesce("plan", F.lit(0.0))).alias("plan_value"), F.sum(F.coalesce("fact", F.lit(0.0))).alias("document_value"),
        F.sort_array(F.collect_list(F.when(F.col("fact").isNull(), F.col("month")))).alias("missing_months"))  # at most 12
    return g.select(*KEY, "from_month", "to_month", "plan_value", F.col("execution_fact").alias("fact_value"), "document_value",
                    percent(F.col("document_value"), F.col("execution_fact")).alias("percent_of_fact"), "missing_months")


def org_breakdown(points: DataFrame, execution: DataFrame, slices: DataFrame) -> DataFrame:
    """(period, indicator, organization): monthly_ratios[12], case_fact, documents_in_slice, percent_of_fact.

    points: ``monthly_series(by_org=True)``, or the ``monthly_table`` it is made of, which needs no grouping;
    execution: period_id, indicator_id, organization_oid, case_fact; an organization that is absent has a null case_fact, not 0.
    """
    a, b = F.col("from_month"), F.col("to_month")
    # one row per (period, indicator): in how many slices each month lies
    s = slices.groupBy(*KEY).agg(F.max(F.coalesce(a <= b, F.lit(False))).alias("__has"), F.array(*[F.count_if(F.lit(m).between(a, b)) for m in MONTHS]).alias("__in"))
    if "months" in points.columns:
        at = [F.col("months")[m - 1] for m in MONTHS]
        g = points.select(*ORG_KEY, F.array(*[c["ratio"] for c in at]).alias("monthly_ratios"), F.array(*[F.coalesce(c["fact"], F.lit(0.0)) for c in at]).alias("__facts"))
    else:
        month = [F.when(F.col("month") == m, F.struct("ratio", F.coalesce("fact", F.lit(0.0)).alias("fact"))) for m in MONTHS]
        g = points.groupBy(*ORG_KEY).agg(F.array(*[F.max(c["ratio"]) for c in month]).alias("monthly_ratios"), F.array(*[F.sum(c["fact"]) for c in month]).alias("__facts"))
    out = g.join(F.broadcast(s), KEY, "left").join(keyed(execution.select(*ORG_KEY, "case_fact")), ORG_KEY, "left")
    inside = [F.when(F.col("__in")[i] > 0, F.col("__in")[i] * F.coalesce(F.col("__facts")[i], F.lit(0.0))).otherwise(0.0) for i in range(len(MONTHS))]
    docs = F.when(F.col("__has"), sum(inside[1:], inside[0]))
    return out.select(*ORG_KEY, "monthly_ratios", "case_fact", docs.alias("documents_in_slice"), percent(docs, F.col("case_fact")).alias("percent_of_fact"))


# --- outlook ----------------------------------------------------------------------------------

def forecast(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Year plan, fact to date, best month, needed per month, ceiling and whether the year is reachable.

    Keys without a positive plan or without any fact give no row.
    """
    fact = F.col("fact")
    g = points.groupBy(*keys).agg(
        F.sum(F.coalesce("plan", F.lit(0.0))).alias("year_plan"), F.sum("fact").alias("fact_to_date"), F.count("fact").alias("months_with_fact"),
        F.max(F.when(fact.isNotNull(), F.col("month"))).alias("__last"), F.max_by("month", F.when(fact.isNotNull(), F.struct(fact, -F.col("month")))).alias("best_month"),
        F.max("fact").alias("best_month_fact")).filter("year_plan > 0 AND months_with_fact > 0")
    left = F.greatest(F.lit(0), 12 - F.col("__last"))
    g = g.withColumn("months_left", left).withColumn("ceiling", F.col("fact_to_date") + F.col("best_month_fact") * F.col("months_left"))
    need = F.when(F.col("months_left") > 0, F.greatest(F.lit(0), F.ceil((F.col("year_plan") - F.col("fact_to_date")) / F.nullif(F.col("months_left"), F.lit(0))))).otherwise(0)
    return g.select(*keys, "year_plan", "fact_to_date", rnd(F.col("fact_to_date") / F.col("year_plan") * 100, 1).alias("fact_share"), "months_with_fact", "months_left",
                    "best_month", "best_month_fact", need.cast("long").alias("required_per_month"), "ceiling",
                    rnd(F.col("ceiling") / F.col("year_plan") * 100, 1).alias("ceiling_share"), (F.col("ceiling") >= F.col("year_plan")).alias("achievable"))


def _finding(df: DataFrame, keys: Sequence[str], code: str, **evidence: Column) -> DataFrame:
    names = ["month", "other_month", "value", "base", "n"]
    return df.select(*keys, F.lit(code).alias("code"), *[evidence.get(n, F.lit(None)).cast("int" if "month" in n else "double").alias(n) for n in names])


def spike_and_drop(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Deepest fall between neighbouring months; the last month with a fact is left out as partial."""
    facts = points.filter("fact IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy("month")  # at most 12 rows per key
    whole = Window.partitionBy(*keys)
    seq = facts.withColumns({"pm": F.lag("month").over(w), "pf": F.lag("fact").over(w), "bm": F.lag("month", 2).over(w), "bf": F.lag("fact", 2).over(w),
                             "last": F.max("month").over(whole), "n": F.count(F.lit(1)).over(whole)})
    drop = seq.filter("n >= 3 AND month = pm + 1 AND fact > 0 AND month <> last").withColumn("ratio", F.col("pf") / F.col("fact")).filter(F.col("ratio") >= DROP_RATIO)
    deepest = drop.groupBy(*keys).agg(F.max_by(F.struct("month", "fact", "pm", "pf", "bm", "bf"), F.struct("ratio", -F.col("month"))).alias("d")).select(*keys, "d.*")
    rise = F.when((F.col("bm") == F.col("pm") - 1) & (F.col("bf") > 0), F.col("pf") / F.nullif(F.col("bf"), F.lit(0.0)))
    return _finding(deepest, keys, "spike_and_drop", month=F.col("pm"), other_month=F.col("month"), value=rnd((1 - F.col("fact") / F.col("pf")) * 100, 1),
                    base=F.when(rise >= SPIKE_RATIO, rnd((rise - 1) * 100, 1)))


def january_tail(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """January well above the mean of the other months."""
    rest = F.when(F.col("month") > 1, F.col("fact"))
    g = points.groupBy(*keys).agg(F.max(F.when(F.col("month") == 1, F.col("fact"))).alias("jan"), F.avg(rest).alias("avg"), F.count(rest).alias("n"))
    return _finding(g.filter((F.col("jan") > 0) & (F.col("n") >= 2) & (F.col("avg") > 0) & (F.col("jan") >= F.col("avg") * JANUARY_TAIL_RATIO)), keys,
                    "january_tail", month=F.lit(1), value=F.col("jan"), base=rnd("avg"))


def flat_plan(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """A full-year plan whose spread is under 1 % of its mean."""
    g = points.groupBy(*keys).agg(F.count("plan").alias("n"), F.min("plan").alias("lo"), F.max("plan").alias("hi"), F.avg("plan").alias("avg"))
    spread = (F.col("hi") - F.col("lo")) / F.nullif(F.col("avg"), F.lit(0.0))
    return _finding(g.filter((F.col("n") >= 12) & (F.col("avg") > 0) & (spread < FLAT_PLAN_SPREAD)), keys, "flat_plan",
                    value=rnd(spread * 100, 1), base=rnd("avg"))


def ratio_over_plan(breakdown: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Organizations above 100 % of the plan in some month: how many (n), the record and its month."""
    top = F.array_max("monthly_ratios")
    rows = breakdown.withColumns({"top": top, "m": F.array_position("monthly_ratios", top).cast("int")})
    over = F.when(F.col("top") > 100, F.col("top"))
    g = rows.groupBy(*keys).agg(F.count("top").alias("with_data"), F.count(over).alias("n"), F.max(over).alias("v"),
                                F.max_by("m", F.when(over.isNotNull(), F.struct(over, -F.col("m")))).alias("m")).filter("n > 0")
    return _finding(g, keys, "ratio_over_plan", month=F.col("m"), value=rnd("v", 1), base=F.col("with_data"), n=F.col("n"))


def missing_execution(breakdown: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    g = breakdown.groupBy(*keys).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("case_fact").isNull()).alias("n")).filter("n > 0")
    return _finding(g, keys, "missing_execution", base=F.col("all"), n=F.col("n"))


def anomalies(points: DataFrame, breakdown: DataFrame | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """All rules unioned: (keys…, code, month, other_month, value, base, n)."""
    out = spike_and_drop(points, keys).unionByName(january_tail(points, keys)).unionByName(flat_plan(points, keys))
    if breakdown is not None:
        out = out.unionByName(ratio_over_plan(breakdown, keys)).unionByName(missing_execution(breakdown, keys))
    return out


def evenness(points: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Lowest and highest monthly ratio; uneven from a factor of 1.5.  Needs two months."""
    r = F.col("ratio")
    has = r.isNotNull()
    g = points.groupBy(*keys).agg(F.count("ratio").alias("n"), F.min("ratio").alias("low"), F.max("ratio").alias("high"),
                                  F.min_by("month", F.when(has, F.struct("ratio", "month"))).alias("low_month"),
                                  F.max_by("month", F.when(has, F.struct(r, -F.col("month")))).alias("high_month")).filter("n >= 2")
    times = F.when(F.col("low") > 0, F.col("high") / F.nullif(F.col("low"), F.lit(0.0)))
    return g.withColumn("uneven", F.coalesce(times >= UNEVEN_RATIO, F.lit(True)))


def verdict(forecasts: DataFrame, found: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """unreachable, uneven, tight, no_execution_data or on_track per key; keys without forecast and finding give no verdict."""
    has = lambda code: F.bool_or(F.col("code") == code)
    flags = found.groupBy(*keys).agg(has("spike_and_drop").alias("__spike"), has("missing_execution").alias("__miss"))
    j = forecasts.withColumn("__f", F.lit(True)).join(flags, list(keys), "full")
    f = F.coalesce("__f", F.lit(False))
    tight = f & (F.col("months_left") > 0) & (F.col("required_per_month") > F.col("fact_to_date") / F.greatest(F.lit(1), F.col("months_with_fact")))
    v = (F.when(f & ~F.col("achievable"), "unreachable").when(F.col("__spike"), "uneven").when(tight, "tight")
         .when(F.col("__miss"), "no_execution_data").when(f, "on_track"))
    return j.select(*keys, v.alias("verdict")).filter("verdict IS NOT NULL")


def percent_band(c: Column) -> Column:
    """Index 0..4 of the band (>= 100, 86.9, 60, 34, 0)."""
    e = F.when(c >= PERCENT_BANDS[0], 0)
    for i, lo in enumerate(PERCENT_BANDS[1:], 1):
        e = e.when(c >= lo, i)
    return e.when(c.isNotNull(), len(PERCENT_BANDS) - 1)


def gap_rows(values: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per organization: gap to plan, share of the total gap, place by gap; null gaps come last.

    The cumulative gap is an ordered scan, so a period with very many organizations is not one task.
    """
    from ..operators.ordered import scan
    calc = F.col("status") == "calculated"
    v = values.withColumn("plan", F.when(calc, F.col("denominator"))).withColumn("fact", F.coalesce("numerator", F.lit(0.0)))
    v = v.withColumn("gap", F.when(F.col("plan").isNotNull(), F.greatest(F.lit(0.0), F.col("plan") - F.col("fact"))))
    v = v.withColumns({"__null": F.col("gap").isNull(), "__neg": -F.coalesce("gap", F.lit(0.0))})
    s = scan(v, {"place": ("sum", F.lit(1).cast("long")), "cum_gap": ("sum", F.coalesce("gap", F.lit(0.0))), "total_gap": ("total", F.coalesce("gap", F.lit(0.0)))},
             ["__null", "__neg", "organization_name", "organization_oid"], keys)
    share = F.when(F.col("gap").isNotNull() & (F.col("total_gap") > 0), rnd(F.col("gap") / F.nullif(F.col("total_gap"), F.lit(0.0)) * 100, 2))
    return s.select(*keys, "organization_oid", "organization_name", "status", "fact", "plan", "gap", share.alias("share_of_gap"), "place", "cum_gap", "total_gap")


def gap_summary(values: DataFrame, share: float = 80, keys: Sequence[str] = KEY) -> DataFrame:
    """Totals, counts by status and how many organizations close ``share`` percent of the gap."""
    rows = gap_rows(values, keys)
    calc = F.col("status") == "calculated"
    reach = F.when((F.col("gap") > 0) & (F.col("cum_gap") >= F.col("total_gap") * share / 100), F.col("place"))
    zero = F.lit(0.0)
    return rows.groupBy(*keys).agg(
        F.max("total_gap").alias("total_gap"), F.coalesce(F.sum(F.when(calc, F.col("fact"))), zero).alias("total_fact"),
        F.coalesce(F.sum("plan"), zero).alias("total_plan"), F.count_if(calc).alias("calculated"),
        F.count_if(F.col("status") == "no_approved_volume").alias("no_approved_volume"),
        F.coalesce(F.sum(F.when(F.col("status") == "no_approved_volume", F.col("fact"))), zero).alias("fact_without_plan"),
        F.count_if(F.col("status") == "not_participating").alias("not_participating"),
        F.coalesce(F.min(reach), F.count_if(F.col("gap") > 0), F.lit(0)).alias("organizations_to_close"))

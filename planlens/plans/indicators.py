"""Ratio indicators.  Everything runs once over all (period, indicator, organization) keys.

Tables
  facts    period_id, organization_oid, type_code, document_count
  plans    period_id, organization_oid, sheet_code, annual_value, monthly_values map<int,double>
  targets  period_id, organization_oid, through_month: the organizations an indicator covers
  config   list of {indicator_id, types, aggregate: sum|max, additional, sheets}; a few entries
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bounded_values, keyed, number, percent
from ..operators.joins import grid

DEFAULT_CRITICAL_POINTS = 10  # fixed value
KEY = ["period_id", "indicator_id"]
ORG_KEY = [*KEY, "organization_oid"]


def assess(df: DataFrame, fact: str = "fact_value", target: str = "target_value", points: str | None = None) -> DataFrame:
    """Adds deviation_value and business_status (target_met / below_target / critical / not_assessed)."""
    d = F.floor((F.col(fact) - F.col(target)) * 100 + 0.5) / 100  # ties go up, also below zero
    raw = number(points) if points else F.lit(None).cast("double")
    limit = F.when(raw > 0, raw).otherwise(float(DEFAULT_CRITICAL_POINTS))
    return df.withColumns({
        "deviation_value": d,
        "business_status": F.when(d.isNull(), "not_assessed").when(d >= 0, "target_met").when(d <= -limit, "critical").otherwise("below_target")})


def ratio_percent(df: DataFrame, points: str | None = None) -> DataFrame:
    """numerator, denominator, target_value, methodology_status → status, fact_value, deviation_value, business_status."""
    dev = F.coalesce(F.col("methodology_status") == "in_development", F.lit(False))
    missing = F.col("numerator").isNull() | F.col("denominator").isNull() | (F.col("denominator") <= 0)
    value = F.when(~dev & ~missing, percent(F.col("numerator"), F.col("denominator")))
    out = df.withColumns({"status": F.when(dev, "methodology_in_development").when(missing, "awaiting_data").otherwise("calculated"), "fact_value": value})
    return assess(out, points=points)


# --- fact-to-plan ratio -------------------------------------------------------------------------

def _type_roles(spark: SparkSession, config: Sequence[Mapping[str, Any]]) -> DataFrame:
    rows = [(c["indicator_id"], t, role) for c in config for role, ts in (("main", c["types"]), ("additional", c.get("additional", []))) for t in ts]
    return F.broadcast(spark.createDataFrame(rows, "indicator_id string, type_code string, role string"))  # a few config entries


def _sheets(spark: SparkSession, config: Sequence[Mapping[str, Any]]) -> DataFrame:
    rows = [(c["indicator_id"], s) for c in config for s in c["sheets"]]
    return F.broadcast(spark.createDataFrame(rows, "indicator_id string, sheet_code string"))  # a few config entries


def of_types(facts: DataFrame, config: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Facts of the types that the config names.  The join with the roles keeps no others, but it stands behind the aggregation
    that ``facts`` often are; this filter moves in front of that."""
    return facts.filter(F.col("type_code").isin(sorted({t for c in config for t in (*c["types"], *c.get("additional", []))})))


def of_sheets(plans: DataFrame, config: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Plans of the sheets that the config names, as ``of_types``."""
    return plans.filter(F.col("sheet_code").isin(sorted({s for c in config for s in c["sheets"]})))


def _max_rule(config: Sequence[Mapping[str, Any]]) -> Column:
    return F.col("indicator_id").isin([c["indicator_id"] for c in config if c.get("aggregate", "sum") == "max"])


def numerators(facts: DataFrame, config: Sequence[Mapping[str, Any]], keys: Sequence[str] = ("period_id", "organization_oid")) -> DataFrame:
    """Numerator per key and indicator: sum of the main types, or their largest, plus the additional ones."""
    spark = facts.sparkSession
    per_type = of_types(facts, config).join(_type_roles(spark, config), "type_code").groupBy(*keys, "indicator_id", "role", "type_code").agg(
        F.sum(F.coalesce(number("document_count"), F.lit(0.0))).alias("n"))
    main, extra = F.when(F.col("role") == "main", F.col("n")), F.when(F.col("role") == "additional", F.col("n"))
    zero = F.lit(0.0)
    return per_type.groupBy(*keys, "indicator_id").agg(
        F.coalesce(F.sum(main), zero).alias("__sum"), F.greatest(zero, F.coalesce(F.max(main), zero)).alias("__max"),
        F.coalesce(F.sum(extra), zero).alias("__extra")).select(
        *keys, "indicator_id", (F.when(_max_rule(config), F.col("__max")).otherwise(F.col("__sum")) + F.col("__extra")).alias("numerator"))


def valid_months(col: str = "monthly_values") -> Column:
    return F.map_filter(col, lambda k, v: k.between(1, 12))


def month_sum(col: str, through: Column) -> Column:
    months = F.map_filter(valid_months(col), lambda k, v: k <= through)
    return F.aggregate(F.map_values(months), F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))


def cumulative_plan(plans: DataFrame, targets: DataFrame) -> DataFrame:
    """(period, organization, sheet) → cumulative_value January..through_month, annual_value, used_annual_fallback.

    Without a monthly breakdown the annual plan stands in and is flagged.
    """
    keys = ["period_id", "organization_oid"]
    rows = plans.join(keyed(targets.select(*keys, "through_month").distinct()), keys)
    g = rows.groupBy(*keys, "sheet_code").agg(
        F.sum(F.coalesce(number("annual_value"), F.lit(0.0))).alias("annual_value"),
        F.sum(F.coalesce(month_sum("monthly_values", F.col("through_month")), F.lit(0.0))).alias("__cum"),
        F.bool_or(F.coalesce(F.size(valid_months()) > 0, F.lit(False))).alias("__has"))
    return g.select(*keys, "sheet_code", F.when(F.col("__has"), F.col("__cum")).otherwise(F.col("annual_value")).alias("cumulative_value"),
                    "annual_value", (~F.col("__has") & (F.col("annual_value") > 0)).alias("used_annual_fallback"))


def plan_ratio(facts: DataFrame, plans: DataFrame, targets: DataFrame, config: Sequence[Mapping[str, Any]]) -> DataFrame:
    """One row per (period, indicator, organization): status, numerator, denominator, annual_denominator,
    used_annual_fallback, percent.  Facts of other organizations are ignored."""
    spark = facts.sparkSession
    keys = ["period_id", "organization_oid"]
    ids = F.array(*[F.lit(c["indicator_id"]) for c in config])
    dense = targets.select(*keys).distinct().withColumn("indicator_id", F.explode(ids))
    den = cumulative_plan(of_sheets(plans, config), targets).join(_sheets(spark, config), "sheet_code").groupBy(*keys, "indicator_id").agg(
        F.sum("cumulative_value").alias("__cum"), F.sum("annual_value").alias("__ann"), F.bool_or("used_annual_fallback").alias("__fb"))
    j = dense.join(numerators(facts, config), [*keys, "indicator_id"], "left").join(den, [*keys, "indicator_id"], "left")
    num, has = F.coalesce("numerator", F.lit(0.0)), F.coalesce(F.col("__ann") > 0, F.lit(False))
    return j.select(*ORG_KEY, F.when(has, "calculated").when(num > 0, "no_approved_volume").otherwise("not_participating").alias("status"),
                    num.alias("numerator"), F.when(has, F.col("__cum")).alias("denominator"), F.when(has, F.col("__ann")).alias("annual_denominator"),
                    F.coalesce("__fb", F.lit(False)).alias("used_annual_fallback"), percent(num, F.when(has, F.col("__cum"))).alias("percent"))


def plan_ratio_region(values: DataFrame) -> DataFrame:
    """Regional roll-up of ``plan_ratio`` per (period, indicator)."""
    zero = F.lit(0.0)
    g = values.groupBy(*KEY).agg(
        F.sum("numerator").alias("numerator"), F.coalesce(F.sum("denominator"), zero).alias("denominator"),
        F.coalesce(F.sum("annual_denominator"), zero).alias("annual_denominator"),
        F.count_if("used_annual_fallback").alias("annual_fallback_organizations"), F.count(F.lit(1)).alias("organizations"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("calculated", "no_approved_volume", "not_participating")],
        F.coalesce(F.sum(F.when(F.col("annual_denominator").isNull(), F.col("numerator"))), zero).alias("numerator_without_plan"))
    return g.withColumn("percent", percent(F.col("numerator"), F.col("denominator")))


def type_breakdown(facts: DataFrame, targets: DataFrame, config: Sequence[Mapping[str, Any]], by_org: bool = False) -> DataFrame:
    """Documents per (period, indicator[, organization], type)."""
    keys = ["period_id", "organization_oid"]
    f = of_types(facts, config).join(keyed(targets.select(*keys).distinct()), keys, "left_semi").join(_type_roles(facts.sparkSession, config), "type_code")
    return f.groupBy(*(ORG_KEY if by_org else KEY), "type_code").agg(F.sum("document_count").alias("document_count"))


def sheet_breakdown(plans: DataFrame, targets: DataFrame, config: Sequence[Mapping[str, Any]], by_org: bool = False) -> DataFrame:
    """Cumulative and annual plan per (period, indicator[, organization], sheet)."""
    p = cumulative_plan(of_sheets(plans, config), targets).join(_sheets(plans.sparkSession, config), "sheet_code")
    return p.groupBy(*(ORG_KEY if by_org else KEY), "sheet_code").agg(
        F.sum("cumulative_value").alias("cumulative_value"), F.sum("annual_value").alias("annual_value"),
        F.bool_or("used_annual_fallback").alias("used_annual_fallback"))


def overachieved(values: DataFrame) -> DataFrame:
    """Findings for organizations above 100 % of a calculated plan, with evidence."""
    over = values.filter((F.col("status") == "calculated") & (F.col("percent") > 100))
    return over.select(*ORG_KEY, F.lit("volume_ratio_overachieved").alias("finding_code"), F.lit("info").alias("severity"),
                       F.struct("numerator", "denominator", "percent", (F.col("numerator") - F.col("denominator")).alias("excess_documents")).alias("evidence"))


# --- type registry coverage -----------------------------------------------------------------------

def type_coverage(facts: DataFrame, registry: DataFrame, targets: DataFrame, requirements: DataFrame | None = None, count_outside: bool = True) -> DataFrame:
    """Per (period, organization): distinct registered types over the registry size, and plan execution.

    facts: period_id, organization_oid, type_id, document_count; registry: type_id; requirements:
    period_id, organization_oid, type_id, status.  A type counts when it has documents.
    ``count_outside`` adds types that are not in the registry to the numerator.
    """
    keys = ["period_id", "organization_oid"]
    g, size, pairs, req = _registered(facts, registry, targets, requirements)
    out = targets.select(*keys).distinct().join(_coverage(pairs, keys), keys, "left")
    return _finish(out, keys, size, req, pairs, count_outside)


def type_coverage_region(facts: DataFrame, registry: DataFrame, targets: DataFrame, requirements: DataFrame | None = None, count_outside: bool = True) -> DataFrame:
    """Per period.  Types are counted distinct over the region, never summed from organizations."""
    keys = ["period_id"]
    g, size, pairs, req = _registered(facts, registry, targets, requirements)
    empty = (targets.select("period_id", "organization_oid").distinct()
             .join(pairs.filter("in_registry"), ["period_id", "organization_oid"], "left_anti")
             .groupBy("period_id").agg(F.count(F.lit(1)).alias("organizations_without_registration")))
    region_pairs = pairs.select("period_id", "type_id", "in_registry").distinct()
    region_req = None if req is None else req.select("period_id", "type_id", "status").distinct()
    out = targets.select("period_id").distinct().join(_coverage(region_pairs, keys), keys, "left")
    done = _finish(out, keys, size, region_req, region_pairs, count_outside)
    return done.join(empty, "period_id", "left").withColumn("organizations_without_registration", F.coalesce("organizations_without_registration", F.lit(0)))


def _registered(facts: DataFrame, registry: DataFrame, targets: DataFrame, requirements: DataFrame | None):
    keys = ["period_id", "organization_oid"]
    reg = registry.select("type_id").distinct().withColumn("in_registry", F.lit(True))
    size = reg.agg(F.count(F.lit(1)).alias("n")).scalar()
    live = facts.filter("document_count > 0").join(keyed(targets.select(*keys).distinct()), keys, "left_semi")
    pairs = live.groupBy(*keys, "type_id").agg(F.sum("document_count").alias("documents")).join(reg, "type_id", "left").withColumn(
        "in_registry", F.coalesce("in_registry", F.lit(False)))
    req = None
    if requirements is not None:
        req = requirements.join(reg.select("type_id"), "type_id", "left_semi").join(keyed(targets.select(*keys).distinct()), keys, "left_semi")
    return reg, size, pairs, req


def _coverage(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count_if("in_registry").alias("__in"), F.count_if(~F.col("in_registry")).alias("__out"))


def _finish(out: DataFrame, keys: Sequence[str], size: Column, req: DataFrame | None, pairs: DataFrame, count_outside: bool) -> DataFrame:
    zero = F.lit(0).cast("long")
    inside, outside = F.coalesce("__in", zero), F.coalesce("__out", zero)
    registered = inside + outside if count_outside else inside
    cols = [*keys, registered.alias("registered_types"), percent(registered, F.col("__size")).alias("percent"), outside.alias("types_outside_registry")]
    out = out.withColumn("__size", size)
    if req is None:
        return out.select(*cols)
    known = pairs.filter("in_registry").select(*keys, "type_id", F.lit(True).alias("__reg"))
    by_status = req.select(*keys, "type_id", "status").distinct().join(known, [*keys, "type_id"], "left").groupBy(*keys).agg(
        F.count_if(F.col("status") == "required").alias("required_types"),
        F.count_if((F.col("status") == "required") & F.col("__reg")).alias("registered_required_types"),
        F.count_if(F.col("status") == "unknown").alias("undefined_types"))
    j = out.join(keyed(by_status), list(keys), "left")
    r = {c: F.coalesce(c, zero) for c in ("required_types", "registered_required_types", "undefined_types")}
    return j.select(*cols, *[e.alias(c) for c, e in r.items()], percent(r["registered_required_types"], r["required_types"]).alias("plan_percent"))


def registry_types(facts: DataFrame, registry: DataFrame, targets: DataFrame) -> DataFrame:
    """(period, type): status registered / not_registered / outside_registry, organizations, documents; the registry is dense."""
    reg, _, pairs, _ = _registered(facts, registry, targets, None)
    periods = targets.select("period_id").distinct()
    per = pairs.groupBy("period_id", "type_id").agg(F.count(F.lit(1)).alias("organizations"), F.sum("documents").alias("documents"))
    dense = grid(periods, reg, "type_id").withColumn("__in", F.lit(True))
    zero = F.lit(0).cast("long")
    return dense.join(per, ["period_id", "type_id"], "full").select(
        "period_id", "type_id", F.when(F.col("__in").isNull(), "outside_registry").when(F.col("organizations") > 0, "registered").otherwise("not_registered").alias("status"),
        F.coalesce("organizations", zero).alias("organizations"), F.coalesce("documents", zero).alias("documents"))


def prior_year(annual: DataFrame, periods: DataFrame) -> DataFrame:
    """Totals per type of the latest year before each period.

    annual: reporting_year, organization_oid, type_id, document_count; periods: period_id, year.
    """
    per = annual.groupBy("reporting_year", "type_id").agg(F.sum("document_count").alias("documents"), F.count_distinct("organization_oid").alias("organizations"))
    years = bounded_values(annual, "reporting_year", 10_000)
    last = periods.withColumn("__years", years).withColumn("reporting_year", F.array_max(F.filter("__years", lambda y: y < F.col("year")))).filter(
        "reporting_year IS NOT NULL")
    return last.join(per, "reporting_year").select("period_id", "reporting_year", "type_id", "documents", "organizations")


# --- targets ----------------------------------------------------------------------------------

def apply_targets(values: DataFrame, targets: DataFrame, keys: Sequence[str] = ("indicator_id", "period_id")) -> DataFrame:
    """Set new targets and reassess.  Ratio indicators are recalculated, others keep value and status."""
    t = targets.select(*keys, F.col("target_value").alias("__t"))
    j = values.join(t, list(keys), "left").withColumn("target_value", F.coalesce("__t", "target_value")).drop("__t")
    ratio = F.col("calculation_type") == "ratio_percent"
    redone = ratio_percent(j.withColumnsRenamed({"status": "__status", "fact_value": "__fact"}))
    kept = redone.withColumns({"status": F.when(ratio, F.col("status")).otherwise(F.col("__status")),
                               "fact_value": F.when(ratio, F.col("fact_value")).otherwise(F.col("__fact"))}).drop("__status", "__fact")
    return assess(kept)


EXPORT_MONTHS = [6, 7, 8, 9, 10, 11]  # fixed value: months with a fact column in the report form


def plan_fact_rows(indicators: DataFrame, values: DataFrame, reporting_date: str | None) -> DataFrame:
    """(item_number, name, indicator_code, unit, fact_month, fact_value, year_end_value, notes) per indicator."""
    month = int(reporting_date[5:7]) if reporting_date else None
    month = month if month in EXPORT_MONTHS else None
    v = values.select("indicator_id", "fact_value", "target_year_end_value", F.col("status").alias("__st"), F.col("note").alias("__note"))
    j = indicators.join(v, "indicator_id", "left")
    year_end = F.col("fact_value") if month is None else F.col("target_year_end_value")
    notes = [F.lit(f"Reporting date: {reporting_date or 'not set'}."),
             F.when(F.coalesce(F.col("__st") != "calculated", F.lit(True)), "Value not calculated."),
             F.when(F.trim("__note") != "", F.trim("__note"))]
    if month is None:
        notes.append(F.lit("The month has no column of its own; the fact stands in the year-end column."))
    else:
        notes.append(F.when(F.col("target_year_end_value").isNull(), "No year-end target is set."))
    return j.select("item_number", "name", "indicator_code", F.when(F.trim("unit") == "%", "percent").otherwise("unit").alias("unit"),
                    F.lit(month).cast("int").alias("fact_month"), "fact_value", year_end.alias("year_end_value"), F.concat_ws(" ", *notes).alias("notes"))

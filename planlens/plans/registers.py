"""Imports and registers: interval facts, reconciliation, dictionaries, facility coverage, snapshot comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent
from ..operators.predicates import effective_predicate


# --- facility register --------------------------------------------------------------------------

def _marked(register: DataFrame, facts: DataFrame) -> DataFrame:
    """Adds ``transmits``: seen in the latest cumulative slice, or the register's own fact where a period has no slice."""
    live = facts.filter("coverage = 'cumulative'")
    last = live.groupBy("period_id").agg(F.max("month").alias("__last"))
    seen = live.filter("document_count > 0").join(last, "period_id").filter("month = __last").select("period_id", "building_id", F.lit(True).alias("__t")).distinct()
    has = seen.select("period_id", F.lit(True).alias("__has")).distinct()
    j = register.join(seen, ["period_id", "building_id"], "left").join(has, "period_id", "left")
    t = F.when(F.col("__has"), F.coalesce("__t", F.lit(False))).otherwise(F.coalesce(F.col("fact_value") > 0, F.lit(False)))
    return j.withColumns({"transmits": t, "by_facts": F.coalesce("__has", F.lit(False))}).drop("__t", "__has")


def register_coverage(register: DataFrame, facts: DataFrame) -> DataFrame:
    """Per period: numerator (planned buildings that transmit, else the register's facts), denominator, percent.

    register: period_id, organization_oid, building_id, plan_value, fact_value; facts: period_id,
    coverage, month, building_id, document_count.
    """
    g = _marked(register, facts).groupBy("period_id").agg(
        F.count_if((F.col("plan_value") > 0) & F.col("transmits")).alias("__n"), F.sum("fact_value").alias("register_fact"), F.sum("plan_value").alias("denominator"),
        F.count_distinct("organization_oid").alias("organizations"), F.bool_or("by_facts").alias("__f"))
    num = F.when(F.col("__f"), F.col("__n")).otherwise(F.col("register_fact"))
    return g.select("period_id", num.alias("numerator"), "denominator", percent(num, F.col("denominator")).alias("percent"), "organizations", "register_fact")


def register_by_org(register: DataFrame, facts: DataFrame) -> DataFrame:
    g = _marked(register, facts).groupBy("period_id", "organization_oid").agg(F.sum("plan_value").alias("denominator"), F.count_if("transmits").alias("numerator"),
                                                                              F.count(F.lit(1)).alias("buildings"))
    return g.withColumn("percent", percent(F.col("numerator"), F.col("denominator")))


def missing_buildings(register: DataFrame, facts: DataFrame) -> DataFrame:
    """Planned buildings that transmit nothing, one row each."""
    return _marked(register, facts).filter((F.col("plan_value") > 0) & ~F.col("transmits")).select("period_id", "organization_oid", "building_id")


# --- interval imports -----------------------------------------------------------------------------

def interval_class(df: DataFrame, start: str = "from_date", end: str = "to_date") -> DataFrame:
    """Adds coverage (month / cumulative / null), month, year of a report interval.

    January alone is a month; a later start that spans months, a start inside a month, or an interval
    over a year end stays undecided.
    """
    a, b = F.col(start), F.col(end)
    ok = (F.year(a) == F.year(b)) & (F.dayofmonth(a) == 1) & (F.month(b) >= F.month(a))
    cov = F.when(ok & (F.month(a) == F.month(b)), "month").when(ok & (F.month(a) == 1), "cumulative")
    return df.withColumns({"coverage": cov, "month": F.when(cov.isNotNull(), F.month(b)), "year": F.when(cov.isNotNull(), F.year(b))})


def _matched(rows: DataFrame, targets: DataFrame, active: DataFrame, aliases: DataFrame, name_key: Callable[[Column], Column]) -> DataFrame:
    """Rows of target organizations with ``__active`` and ``type_id``; names are normalized once per distinct name."""
    names = rows.select("document_type_name").distinct().withColumn("__k", name_key(F.col("document_type_name")))
    known = aliases.select(name_key(F.col("alias")).alias("__k"), "type_id").groupBy("__k").agg(F.min("type_id").alias("type_id"), F.max("type_id").alias("__other"))
    keyed = names.join(known.filter("type_id = __other").drop("__other"), "__k", "left").drop("__k")  # an alias of several types stays unmatched
    return (rows.join(targets.select("organization_oid").distinct(), "organization_oid", "left_semi")
            .join(active.select("organization_oid", F.lit(True).alias("__active")).distinct(), "organization_oid", "left")
            .join(keyed, "document_type_name", "left"))


def aggregate_interval(rows: DataFrame, targets: DataFrame, active: DataFrame, aliases: DataFrame, name_key: Callable[[Column], Column],
                       by_building: bool = False, order_by: str | None = None) -> DataFrame:
    """Documents per (organization, type) or (organization, building, type); a row without building is not a building.

    A building keeps the name and address of its first row in ``order_by``, or of the least pair without an order.
    A function of one batch, so a streaming ``foreachBatch`` can call it as well.
    """
    m = _matched(rows, targets, active, aliases, name_key).filter("__active AND type_id IS NOT NULL")
    if not by_building:
        return m.groupBy("organization_oid", "type_id").agg(F.sum("document_count").alias("document_count"))
    about = F.struct(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("building_name", "building_address")])
    first = F.min(about) if order_by is None else F.min_by(about, order_by)
    sums = m.filter("building_id <> ''").groupBy("organization_oid", "building_id", "type_id").agg(F.sum("document_count").alias("document_count"), first.alias("about"))
    return sums.select("organization_oid", "building_id", "about.building_name", "about.building_address", "type_id", "document_count")


def unmatched(rows: DataFrame, targets: DataFrame, active: DataFrame, aliases: DataFrame, name_key: Callable[[Column], Column]) -> DataFrame:
    """(kind, value) of organizations that are not active and of names without a type."""
    m = _matched(rows, targets, active, aliases, name_key)
    orgs = m.filter("__active IS NULL").select(F.lit("organization").alias("kind"), F.col("organization_oid").cast("string").alias("value"))
    names = m.filter("__active AND type_id IS NULL").select(F.lit("document_type").alias("kind"), F.col("document_type_name").alias("value"))
    return orgs.unionByName(names).distinct()


# --- reconciliation -------------------------------------------------------------------------------

# fixed values: check → (left figure, right figure, severity)
CHECKS = {
    "region_total_vs_columns": ("region_total", "region_columns", "warning"),
    "region_vs_institutions": ("region_total", "institution_total", "error"),
    "region_vs_subdivisions": ("region_total", "subdivision_total", "error"),
    "institution_totals_vs_columns": ("institution_total", "institution_columns", "warning"),
    "subdivision_totals_vs_columns": ("subdivision_total", "subdivision_columns", "warning"),
    "region_columns_vs_institution_columns": ("region_columns", "institution_columns", "warning"),
    "region_columns_vs_subdivision_columns": ("region_columns", "subdivision_columns", "warning")}


def reconcile(totals: DataFrame, columns: DataFrame, keys: Sequence[str] = ("period_id",)) -> DataFrame:
    """Seven checks per period: (check, expected, actual, status, severity).

    totals: period_id, level (region | institution | subdivision), declared_total; columns: period_id, level, count.
    """
    def per_level(df: DataFrame, value: str, suffix: str) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("level") == lv, F.col(value))), F.lit(0)).alias(f"{lv}_{suffix}")
                                       for lv in ("region", "institution", "subdivision")])
    j = per_level(totals, "declared_total", "total").join(per_level(columns, "count", "columns"), list(keys), "full").na.fill(0)
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(a).alias("expected"), F.col(b).alias("actual"),
                              F.when(F.col(a) == F.col(b), "passed").otherwise("failed").alias("status"), F.lit(s).alias("severity"))
                     for c, (a, b, s) in CHECKS.items()])
    return j.select(*keys, F.inline(rows))


def quality_issues(rows: DataFrame, declared: DataFrame, id_col: str, keys: Sequence[str] = ("period_id",)) -> DataFrame:
    """(code, subject, expected, actual): ids that occur more than once, and sheets whose declared row count is wrong.

    declared: period_id, declared_rows.
    """
    dup = rows.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *keys, F.lit("duplicate_id").alias("code"), F.col(id_col).cast("string").alias("subject"), F.lit(1).cast("long").alias("expected"), F.col("n").alias("actual"))
    read = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    bad = declared.join(read, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("declared_rows IS NOT NULL AND declared_rows <> n").select(
        *keys, F.lit("declared_count_mismatch").alias("code"), F.lit(None).cast("string").alias("subject"), F.col("declared_rows").cast("long").alias("expected"), F.col("n").alias("actual"))
    return dup.unionByName(bad)


# --- dictionary versions ----------------------------------------------------------------------------

def resolve_dictionary(versions: DataFrame, date: str) -> DataFrame:
    """Per type: canonical name and id of the newest active version (else newest), activity, flag (any active),
    validity hull, number of names and formats, and whether active versions disagree.

    versions: type_code, id, base_name, document_format, available, effective_from, effective_to.
    """
    active = F.coalesce(effective_predicate(date), F.lit(False))
    order = F.struct(active.alias("a"), F.coalesce(F.col("effective_from").cast("string"), F.lit("")).alias("f"), F.col("id").try_cast("double").alias("n"))
    flag = F.when(active, F.col("available"))
    g = versions.groupBy("type_code").agg(
        F.max_by(F.struct("id", "base_name"), order).alias("c"), F.count_if(active).alias("active_versions"), F.count(F.lit(1)).alias("versions"),
        F.bool_or(flag).alias("available"), F.bool_and(flag).alias("__all"), F.min("effective_from").alias("effective_from"),
        F.when(F.count_if(F.col("effective_to").isNull()) == 0, F.max("effective_to")).alias("effective_to"),
        F.count_distinct("base_name").alias("names"), F.count_distinct("document_format").alias("formats"))
    return g.select("type_code", F.col("c.id").alias("canonical_id"), F.col("c.base_name").alias("canonical_name"), (F.col("active_versions") > 0).alias("is_active"),
                    "available", F.coalesce(F.col("available") & ~F.col("__all"), F.lit(False)).alias("conflict"), "versions", "names", "formats", "effective_from", "effective_to")


def dictionary_aliases(versions: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(type_code, alias) of all version names and declared extra names."""
    out = versions.select("type_code", F.col("base_name").alias("alias"))
    return (out if extra is None else out.unionByName(extra.select("type_code", "alias"))).distinct()


# --- snapshot comparison --------------------------------------------------------------------------

def changed_pairs(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("organization_oid", "type_id"), value: str = "requirement_status") -> DataFrame:
    """(keys…, was, now) of pairs whose status differs; null means absent."""
    b = before.select(*keys, F.col(value).alias("was"))
    a = after.select(*keys, F.col(value).alias("now"))
    return b.join(a, list(keys), "full").filter(~F.col("was").eqNullSafe(F.col("now")))


def transitions(changed: DataFrame) -> DataFrame:
    return changed.groupBy("was", "now").agg(F.count(F.lit(1)).alias("n"))


def changed_values(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("indicator_id", "organization_oid"),
                   values: Sequence[str] = ("fact_value", "numerator", "denominator")) -> DataFrame:
    """Organization values that changed in any figure, with both sides."""
    b = before.select(*keys, *[F.col(v).alias(f"{v}_was") for v in values])
    a = after.select(*keys, *[F.col(v).alias(f"{v}_now") for v in values])
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_was").eqNullSafe(F.col(f"{v}_now"))
    return b.join(a, list(keys), "full").filter(~same)


def renamed(before: DataFrame, after: DataFrame, key: str = "organization_oid", name: str = "organization_name") -> DataFrame:
    b = before.select(key, F.col(name).alias("was")).distinct()
    return b.join(after.select(key, F.col(name).alias("now")).distinct(), key).filter("was <> now")


def finding_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(finding_code, was, now, delta)."""
    count = lambda d, n: d.groupBy("finding_code").agg(F.count(F.lit(1)).alias(n))
    j = count(before, "was").join(count(after, "now"), "finding_code", "full").na.fill(0, ["was", "now"])
    return j.withColumn("delta", F.col("now") - F.col("was"))


NO_CONDITION = "unconditional"


def stated_condition(reason: Column) -> Column:
    """The condition that a requirement's reason states in brackets, ``… (row 28: condition; …)``: from the first colon
    inside to the first semicolon or the closing bracket."""
    brackets = F.get(F.split(F.coalesce(reason, F.lit("")), "[(]", 2), F.lit(1))
    closed = F.regexp_replace(brackets, "[)][^)]*$", "")
    first = F.trim(F.get(F.split(F.get(F.split(closed, ":", 2), F.lit(1)), ";"), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(NO_CONDITION))


def requirement_breakdown(requirements: DataFrame, keys: Sequence[str] = ("organization_oid",)) -> DataFrame:
    """Required types per (organization, condition) with how many are registered.

    requirements: organization_oid, type_id, status, reason, registered boolean.
    """
    r = requirements.filter("status = 'required'").withColumn("condition", stated_condition(F.col("reason")))
    return r.groupBy(*keys, "condition").agg(F.count(F.lit(1)).alias("types"), F.count_if("registered").alias("registered"))

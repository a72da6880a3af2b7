"""Type coverage of organizations against an applicability matrix, and the findings behind it.

Tables
  types         type_id, name, in_reference boolean, registry_visible boolean, reference_visible boolean
  facts         period_id, scope_level (region | organization), organization_oid, type_id, document_count
  targets       period_id, organization_oid
  requirements  period_id, organization_oid, type_id, requirement_status, available boolean, is_manual boolean
  external      type_id handled in another information system
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded_values, keyed, one_row, percent
from ..operators.joins import grid
from ..operators.ranking import SEVERITIES, severity_rank

TARGET_TYPES = 35              # fixed value: regional target
REGION_CRITICAL_TYPES = 10     # fixed value
ORG_CRITICAL_SHARE = 0.25      # fixed value
MAX_TYPES = 10_000             # size up to which a type directory is exploded, as in ``joins.grid``
ORG = ["period_id", "organization_oid"]


def visible() -> Column:
    """The registry flag wins, the reference flag stands in while the registry has none."""
    return F.coalesce("registry_visible", "reference_visible")


def target_types(types: DataFrame) -> DataFrame:
    return types.filter(F.col("in_reference") & visible())


def readiness_state(catalog: Column, unknown: Column, available: Column, has_data: Column) -> Column:
    return (F.when(~has_data, "data_missing").when(catalog == 0, "reference_missing").when(unknown == catalog, "reference_missing")
            .when(unknown > 0, "reference_incomplete").when(available == 0, "reference_empty").otherwise("ready"))


def _type_counts(types: DataFrame) -> Column:
    ref = F.col("in_reference")
    return one_row(types.agg(F.count_if(ref).alias("catalog"), F.count_if(ref & visible().isNull()).alias("unknown"), F.count_if(ref & visible()).alias("available")))


def fact_types(facts: DataFrame) -> DataFrame:
    """(period, type) seen: the region's own facts, or the union of the organizations' where a period has none."""
    live = facts.filter("document_count > 0")
    region = live.filter("scope_level = 'region'").select("period_id", "type_id").distinct()
    rest = live.filter("scope_level = 'organization'").select("period_id", "type_id").distinct().join(region.select("period_id").distinct(), "period_id", "left_anti")
    return region.unionByName(rest)


def readiness(types: DataFrame, facts: DataFrame, periods: DataFrame) -> DataFrame:
    """(period, readiness, catalog, unknown, available)."""
    c = _type_counts(types)
    seen = facts.filter("document_count > 0").select("period_id", F.lit(True).alias("__d")).distinct()
    j = periods.select("period_id").distinct().join(seen, "period_id", "left").withColumns({k: c.getField(k) for k in ("catalog", "unknown", "available")})
    return j.select("period_id", readiness_state(F.col("catalog"), F.col("unknown"), F.col("available"), F.coalesce("__d", F.lit(False))).alias("readiness"),
                    "catalog", "unknown", "available")


def pilot_region(types: DataFrame, facts: DataFrame, periods: DataFrame, target: int = TARGET_TYPES) -> DataFrame:
    """Per period: readiness, actual and planned types, coverage, and the assessment against a fixed target."""
    seen = fact_types(facts).join(target_types(types).select("type_id"), "type_id", "left_semi").groupBy("period_id").agg(F.count(F.lit(1)).alias("__a"))
    j = readiness(types, facts, periods).join(seen, "period_id", "left")
    ready = F.col("readiness") == "ready"
    actual, planned = F.when(ready, F.coalesce("__a", F.lit(0))), F.when(ready, F.col("available"))
    out = j.select("period_id", "readiness", actual.alias("actual_types"), planned.alias("planned_types"), percent(actual, planned).alias("coverage_percent"))
    d = F.col("actual_types") - target
    return out.withColumns({"deviation_value": d, "business_status": F.when(d.isNull(), "not_assessed").when(d >= 0, "target_met")
                            .when(d <= -REGION_CRITICAL_TYPES, "critical").otherwise("below_target")})


def pair_status(requirement: Column, registered: Column, available: Column) -> Column:
    """One of eight states of an (organization, type) pair."""
    return (F.when(requirement == "required", F.when(registered, "required_registered").when(~available, "required_unavailable")
                   .when(available, "required_missing").otherwise("required_unknown"))
            .when(requirement == "not_required", F.when(registered, "not_required_registered").otherwise("not_required"))
            .otherwise(F.when(registered, "unknown_registered").otherwise("unknown")))


def classify_pairs(types: DataFrame, facts: DataFrame, targets: DataFrame, requirements: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Every (period, organization, target type): requirement, registration, availability, state."""
    dense = grid(targets.select(*ORG).distinct(), target_types(types), "type_id")
    live = facts.filter("scope_level = 'organization' AND document_count > 0").select(*ORG, "type_id", F.lit(True).alias("__reg")).distinct()
    stated = requirements.select(*ORG, "type_id", "requirement_status", "available", "is_manual")
    j = dense.join(keyed(stated), [*ORG, "type_id"], "left").join(keyed(live), [*ORG, "type_id"], "left")
    if external is not None:
        j = j.join(external.select("type_id", F.lit(True).alias("__ext")).distinct(), "type_id", "left")
    else:
        j = j.withColumn("__ext", F.lit(False))
    req, reg = F.coalesce("requirement_status", F.lit("missing")), F.coalesce("__reg", F.lit(False))
    return j.select(*ORG, "type_id", req.alias("requirement_status"), reg.alias("registered"), "available", F.coalesce("is_manual", F.lit(False)).alias("is_manual"),
                    F.coalesce("__ext", F.lit(False)).alias("external"), pair_status(req, reg, F.col("available")).alias("pair_status"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Per (period, organization): number of pairs by requirement and reason."""
    st, req = F.col("pair_status"), F.col("requirement_status")
    missing_here = (st == "required_missing")
    return pairs.groupBy(*ORG).agg(
        F.count_if(req == "required").alias("required_types"), F.count_if(req == "not_required").alias("not_required_types"),
        F.count_if(req == "missing").alias("missing_rules"), F.count_if(req == "unknown").alias("unknown_rules"),
        F.count_if("is_manual").alias("manual_overrides"), F.count_if("registered").alias("registered_types"),
        F.count_if(st == "required_registered").alias("__actual"), F.count_if(st == "required_unavailable").alias("blocked"),
        F.count_if(missing_here & ~F.col("external")).alias("missing_at_organization"), F.count_if(missing_here & F.col("external")).alias("handled_externally"),
        F.count_if(st == "required_unknown").alias("unknown_capability"), F.count_if(st == "not_required_registered").alias("unexpected"))


def packed_counts(types: DataFrame, facts: DataFrame, targets: DataFrame, requirements: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``pair_counts`` over the pairs of ``classify_pairs``, in one aggregation: a row has a bit for each of 64 target types.

    Single pairs are neither listed nor joined.  A pair whose requirement is stated twice alike counts once.
    """
    at = F.expr("shiftleft(1L, CAST(__at % 64 AS INT))")
    place = types.sparkSession.range(1).select(F.posexplode(bounded_values(target_types(types), "type_id", MAX_TYPES)).alias("__at", "type_id")).select(
        "type_id", F.expr("CAST(__at DIV 64 AS INT)").alias("__block"), at.alias("__bit"))
    out = place.join(external.select("type_id").distinct(), "type_id", "left_semi") if external is not None else place.limit(0)
    blocks = place.select("__block", F.col("__bit").alias("__all")).unionByName(out.select("__block", F.col("__bit").alias("__ext")), allowMissingColumns=True).groupBy("__block").agg(
        F.bit_or("__all").alias("__all"), F.bit_or("__ext").alias("__ext")).agg(F.collect_list(F.struct("__block", "__all", "__ext")).alias("b"))
    known = lambda df: df.filter("period_id IS NOT NULL AND organization_oid IS NOT NULL").join(F.broadcast(place), "type_id")
    bit = lambda c, name: F.when(c, F.col("__bit")).alias(name)
    req, has = F.coalesce("requirement_status", F.lit("missing")), F.col("available")
    stated = known(requirements).select(
        *ORG, "__block", bit((req == "required") & has, "__has"), bit((req == "required") & ~has, "__lacks"), bit((req == "required") & has.isNull(), "__open"),
        bit(req == "not_required", "__not"), bit(req == "unknown", "__unknown"), bit(req == "missing", "__missing"), bit(~req.isin("required", "not_required", "unknown", "missing"), "__other"), bit(F.col("is_manual"), "__manual"))
    live = known(facts.filter("scope_level = 'organization' AND document_count > 0")).select(*ORG, "__block", F.col("__bit").alias("__reg"))
    rows = targets.select(*ORG, F.inline(blocks.scalar())).unionByName(stated, allowMissingColumns=True).unionByName(live, allowMissingColumns=True)
    packed = rows.groupBy(*ORG, "__block").agg(*[F.bit_or(c).alias(c) for c in rows.columns if c not in (*ORG, "__block")]).filter("__all IS NOT NULL")

    def some(*names: str) -> Column:
        bits = F.lit(0).cast("long")
        for c in names:
            bits = bits.bitwiseOR(F.coalesce(c, F.lit(0).cast("long")))
        return bits

    def count(*parts: Column) -> Column:
        n = F.bit_count(parts[0])
        for c in parts[1:]:
            n = n + F.bit_count(c)
        return F.sum(n)

    reg, ext = some("__reg"), some("__ext")
    free = F.bitwise_not(reg)
    missing_here = some("__has").bitwiseAND(free)
    ruled = some("__has", "__lacks", "__open", "__not", "__unknown", "__missing", "__other")
    required = [some(c) for c in ("__has", "__lacks", "__open")]
    return packed.groupBy(*ORG).agg(
        count(*required).alias("required_types"), count(some("__not")).alias("not_required_types"),
        count(some("__all").bitwiseAND(F.bitwise_not(ruled)), some("__missing")).alias("missing_rules"), count(some("__unknown")).alias("unknown_rules"),
        count(some("__manual")).alias("manual_overrides"), count(reg).alias("registered_types"),
        count(*[c.bitwiseAND(reg) for c in required]).alias("__actual"), count(some("__lacks").bitwiseAND(free)).alias("blocked"),
        count(missing_here.bitwiseAND(F.bitwise_not(ext))).alias("missing_at_organization"), count(missing_here.bitwiseAND(ext)).alias("handled_externally"),
        count(some("__open").bitwiseAND(free)).alias("unknown_capability"), count(some("__not").bitwiseAND(reg)).alias("unexpected")).withColumns(
        {c: F.col(c).cast(targets.schema[c].dataType) for c in ORG})


def pilot_org(pairs: DataFrame, readiness_table: DataFrame) -> DataFrame:
    """``assess_org`` over the pairs of ``classify_pairs``."""
    return assess_org(pair_counts(pairs), readiness_table)


def assess_org(counts: DataFrame, readiness_table: DataFrame) -> DataFrame:
    """Per (period, organization): counts by requirement and reason, coverage, readiness, assessment.

    counts: ``pair_counts`` or ``packed_counts``.  Coverage is preliminary while some rules are missing or undefined
    and at least one type is required.  The readiness table has one row per period and is broadcast: by a join
    on the period all organizations of a period would meet in one task.
    """
    j = counts.join(F.broadcast(readiness_table.select("period_id", F.col("readiness").alias("__ready"))), "period_id", "left")
    ready = F.col("__ready") == "ready"
    complete = (F.col("missing_rules") == 0) & (F.col("unknown_rules") == 0)
    preliminary = ready & ~complete & (F.col("required_types") > 0)
    counted = ready & (complete | (F.col("required_types") > 0))
    actual, planned = F.when(counted, F.col("__actual")), F.when(counted, F.col("required_types"))
    d = F.when(ready & complete & (planned > 0), actual - planned)
    critical = F.greatest(F.lit(1), F.ceil(planned * ORG_CRITICAL_SHARE))
    return j.select(
        *ORG, F.when(~ready, F.col("__ready")).when(~complete, "applicability_incomplete").when(planned == 0, "not_applicable").otherwise("ready").alias("readiness"),
        preliminary.alias("is_preliminary"), actual.alias("actual_types"), planned.alias("planned_types"), percent(actual, planned).alias("coverage_percent"),
        "required_types", "not_required_types", "missing_rules", "unknown_rules", "manual_overrides", "registered_types", "blocked", "missing_at_organization",
        "handled_externally", "unknown_capability", "unexpected",
        F.when(~ready, "awaiting_data").when(~complete, F.when(preliminary, "calculated").otherwise("awaiting_data")).when(planned == 0, "not_calculated")
        .otherwise("calculated").alias("status"),
        F.when(d.isNull(), "not_assessed").when(d >= 0, "target_met").when(d <= -critical, "critical").otherwise("below_target").alias("business_status"),
        d.alias("deviation_value"))


# --- findings ---------------------------------------------------------------------------------

# fixed values: code → (severity, who is responsible)
RULES = {
    "data_missing": ("error", "import operator"), "reference_missing": ("error", "directory administrator"),
    "reference_incomplete": ("error", "directory administrator"), "reference_empty": ("error", "directory administrator"),
    "visibility_source_mismatch": ("warning", "directory administrator"), "document_type_unmapped": ("error", "directory administrator"),
    "organization_not_in_directory": ("warning", "directory administrator"), "subdivision_not_in_directory": ("warning", "directory administrator"),
    "applicability_matrix_not_loaded": ("error", "analyst"), "organization_without_subdivisions": ("warning", "organization"),
    "requirement_waived_organization_absent": ("info", "analyst"), "capability_contradicts_facts": ("warning", "directory administrator"),
    "applicability_incomplete": ("warning", "analyst"), "type_not_implemented": ("warning", "system supplier"),
    "type_handled_in_external_system": ("error", "organization"), "required_type_not_registered": ("error", "organization"),
    "capability_unknown": ("warning", "system supplier"), "registered_when_not_required": ("info", "analyst")}


#: Code → (why it arises, what to do about it).
REASONS = {
    "data_missing": ("the period has no facts", "load the facts of the period"),
    "reference_missing": ("the type directory is empty or states no visibility", "load the type directory"),
    "reference_incomplete": ("some types of the directory state no visibility", "complete the visibility flags"),
    "reference_empty": ("the directory marks no type as visible", "check the visibility flags"),
    "visibility_source_mismatch": ("registry and reference disagree on the visibility of the type", "decide which source holds and correct the other"),
    "document_type_unmapped": ("imported names match no type of the directory", "add the names as aliases of a type"),
    "organization_not_in_directory": ("facts name an organization that the directory lacks", "add the organization or correct its identifier"),
    "subdivision_not_in_directory": ("facts name subdivisions that the directory lacks", "add the subdivisions or correct their identifiers"),
    "applicability_matrix_not_loaded": ("the period has no applicability rules", "load the applicability matrix"),
    "organization_without_subdivisions": ("the directory lists no subdivision of the organization", "add its subdivisions"),
    "requirement_waived_organization_absent": ("the organization is not in the plan of the period", "confirm that the requirement does not hold"),
    "capability_contradicts_facts": ("organizations register a type that the directory calls unavailable", "correct the availability in the directory"),
    "applicability_incomplete": ("rules are missing or undecided for the organization", "decide the open rules"),
    "type_not_implemented": ("the type is required, its system does not support it", "plan the support of the type"),
    "type_handled_in_external_system": ("the type is required and kept in another system", "connect the other system"),
    "required_type_not_registered": ("the type is required and available, nothing is registered", "begin to register the type"),
    "capability_unknown": ("the type is required, its availability is not stated", "state the availability of the type"),
    "registered_when_not_required": ("the type is registered though not required", "check the rule of the type")}
FINDING_GROUP = ("period_id", "finding_code", "responsibility_area", "cause", "recommendation")


def finding(df: DataFrame, code: str, organization: Column | None = None, typ: Column | None = None, **evidence: Column) -> DataFrame:
    """Rows of one rule: (period_id, organization_oid, type_id, finding_code, severity, responsibility_area, cause, recommendation, evidence json)."""
    severity, area = RULES[code]
    cause, advice = REASONS[code]
    proof = F.to_json(F.struct(*[c.alias(k) for k, c in evidence.items()])) if evidence else F.lit("{}")
    none = F.lit(None).cast("string")
    return df.select("period_id", (organization.cast("string") if organization is not None else none).alias("organization_oid"),
                     (typ.cast("string") if typ is not None else none).alias("type_id"), F.lit(code).alias("finding_code"), F.lit(severity).alias("severity"),
                     F.lit(area).alias("responsibility_area"), F.lit(cause).alias("cause"), F.lit(advice).alias("recommendation"), proof.alias("evidence"))


def reference_findings(ready: DataFrame) -> DataFrame:
    """One finding per period that is not ready."""
    out = None
    for state in ("data_missing", "reference_missing", "reference_incomplete", "reference_empty"):
        part = finding(ready.filter(F.col("readiness") == state), state, catalog=F.col("catalog"), unknown=F.col("unknown"))
        out = part if out is None else out.unionByName(part)
    return out


def source_mismatch_findings(types: DataFrame, periods: DataFrame) -> DataFrame:
    """Types whose two visibility flags disagree, for every period."""
    bad = types.filter("registry_visible IS NOT NULL AND reference_visible IS NOT NULL AND registry_visible <> reference_visible")
    return finding(grid(periods.select("period_id").distinct(), bad, "type_id"), "visibility_source_mismatch", typ=F.col("type_id"))


def data_quality_findings(unmapped_types: DataFrame, unknown_orgs: DataFrame, unknown_subdivisions: DataFrame, rule_counts: DataFrame, bare_orgs: DataFrame) -> DataFrame:
    """Import and directory gaps.

    unmapped_types: period_id, name; unknown_orgs: period_id, organization_oid; unknown_subdivisions:
    period_id, oid, document_count; rule_counts: period_id, rules; bare_orgs: period_id, organization_oid.
    """
    names = unmapped_types.groupBy("period_id").agg(F.count_distinct("name").alias("n"))
    subs = unknown_subdivisions.groupBy("period_id").agg(F.count(F.lit(1)).alias("n"), F.sum("document_count").alias("docs"), F.max_by("oid", "document_count").alias("largest"))
    return (finding(names, "document_type_unmapped", unmapped_type_count=F.col("n"))
            .unionByName(finding(unknown_orgs, "organization_not_in_directory", organization_oid=F.col("organization_oid")))
            .unionByName(finding(subs, "subdivision_not_in_directory", unknown_subdivision_count=F.col("n"), documents=F.col("docs"), largest=F.col("largest")))
            .unionByName(finding(rule_counts.filter("rules = 0"), "applicability_matrix_not_loaded"))
            .unionByName(finding(bare_orgs, "organization_without_subdivisions", F.col("organization_oid"))))


def waived_findings(requirements: DataFrame) -> DataFrame:
    """Requirements dropped because the organization is absent from the plan (``waived`` flag)."""
    return finding(requirements.filter("waived"), "requirement_waived_organization_absent", F.col("organization_oid"), F.col("type_id"))


def capability_conflicts(facts: DataFrame, directory: DataFrame) -> DataFrame:
    """Types the directory (type_id, available) calls unavailable although organizations register them."""
    live = facts.filter("scope_level = 'organization' AND document_count > 0").join(directory.filter("NOT available").select("type_id"), "type_id", "left_semi")
    g = live.groupBy("period_id", "type_id").agg(F.count_distinct("organization_oid").alias("n"))
    return finding(g, "capability_contradicts_facts", typ=F.col("type_id"), registered_organizations=F.col("n"))


def pair_findings(pairs: DataFrame, orgs: DataFrame) -> DataFrame:
    """Findings of single pairs, one pass over the pairs, and of organizations with incomplete rules."""
    st = F.col("pair_status")
    code = (F.when(st == "required_unavailable", "type_not_implemented").when((st == "required_missing") & F.col("external"), "type_handled_in_external_system")
            .when(st == "required_missing", "required_type_not_registered").when(st == "required_unknown", "capability_unknown")
            .when(st == "not_required_registered", "registered_when_not_required"))
    rules = F.create_map(*[x for k, v in RULES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in (*v, *REASONS[k])]))])
    p = pairs.withColumn("finding_code", code).filter("finding_code IS NOT NULL").withColumn("__r", F.element_at(rules, F.col("finding_code")))
    named = ("severity", "responsibility_area", "cause", "recommendation")
    one = p.select("period_id", F.col("organization_oid").cast("string").alias("organization_oid"), F.col("type_id").cast("string").alias("type_id"),
                   "finding_code", *[F.col("__r")[i].alias(c) for i, c in enumerate(named)],
                   F.to_json(F.struct("requirement_status", "registered", "available", "external", "is_manual")).alias("evidence"))
    gaps = orgs.filter("readiness = 'applicability_incomplete'")
    return one.unionByName(finding(gaps, "applicability_incomplete", F.col("organization_oid"), required=F.col("required_types"),
                                   missing_rules=F.col("missing_rules"), unknown_rules=F.col("unknown_rules")))


def all_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def group_findings(findings: DataFrame, keys: Sequence[str] = FINDING_GROUP) -> DataFrame:
    """One row per reason: worst severity, number of findings, distinct organizations and types; errors first.

    Members and evidence are listed by ``finding_members`` and ``finding_evidence`` as rows, so a reason that
    touches everybody stays spread out.
    """
    g = findings.groupBy(*keys).agg(F.min(severity_rank("severity")).alias("__w"), F.count(F.lit(1)).alias("finding_count"),
                                    F.count_distinct("organization_oid").alias("organizations"), F.count_distinct("type_id").alias("types"))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES], F.lit("other")), F.col("__w") + 1)
    return g.withColumn("severity", worst).drop("__w").orderBy(severity_rank("severity"), F.desc("finding_count"), *keys)


def finding_evidence(findings: DataFrame, keys: Sequence[str] = FINDING_GROUP) -> DataFrame:
    """(keys…, name, value, n): each value that the evidence of a reason states, and in how many findings."""
    stated = F.explode(F.from_json("evidence", "map<string,string>")).alias("name", "value")
    return findings.select(*keys, stated).groupBy(*keys, "name", "value").agg(F.count(F.lit(1)).alias("n"))


def finding_members(findings: DataFrame, keys: Sequence[str] = FINDING_GROUP) -> DataFrame:
    """(keys…, kind, member) of the organizations and types behind each reason."""
    parts = F.array(F.struct(F.lit("organization").alias("kind"), F.col("organization_oid").alias("member")), F.struct(F.lit("type").alias("kind"), F.col("type_id").alias("member")))
    return findings.select(*keys, F.inline(parts)).filter("member IS NOT NULL").distinct()


# --- flags ------------------------------------------------------------------------------------

ATTENTION = ["not_required_registered", "unknown_registered"]
PROBLEM = ["required_missing", "required_unavailable", "required_unknown", "not_required_registered"]


def attention(status: str = "pair_status") -> Column:
    return F.col(status).isin(ATTENTION)


def flags(orgs: DataFrame) -> DataFrame:
    """Adds has_problem, target_met, needs_denominator, has_manual.

    orgs: fact_value, target_value and the counts of ``pilot_org``.
    """
    below = F.coalesce(F.col("fact_value") < F.col("target_value"), F.lit(False))
    some = F.lit(False)
    for c in ("missing_at_organization", "blocked", "unknown_capability", "unexpected"):
        some = some | (F.coalesce(c, F.lit(0)) > 0)
    return orgs.withColumns({"has_problem": below | some, "target_met": F.coalesce(F.col("fact_value") >= F.col("target_value"), F.lit(False)),
                             "needs_denominator": F.col("fact_value").isNull() | F.col("target_value").isNull(),
                             "has_manual": F.coalesce("manual_overrides", F.lit(0)) > 0})


def flag_counts(orgs: DataFrame, keys: Sequence[str] = ("period_id",)) -> DataFrame:
    return flags(orgs).groupBy(*keys).agg(*[F.count_if(c).alias(c) for c in ("has_problem", "target_met", "needs_denominator", "has_manual")])

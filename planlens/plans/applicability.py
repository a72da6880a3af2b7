"""Applicability of document types to organizations.

Tables
  rules        rule_id, type_id, requirement_status, subdivision_type, subdivision_kind, condition_code,
               excludes boolean, has_list boolean, from_directory boolean, grounds array<int>
  rule_lists   rule_id, organization_oid: resolved organization lists of conditional rules
  subdivisions organization_oid, subdivision_type, subdivision_kind, name
  plan         organization_oid, sheet_code, annual_value
  plan_rules   type_id, sheet_code, zero_means_not_required: which plan sections decide a type
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import set_diff
from ..operators.joins import grid

PLAN_GROUND, ENTRY_GROUND = 2, 1  # fixed values: levels of the grounds of a rule
INPATIENT, DAY, HOSPITAL = "стационарный", "дневн", "стационар"  # fixed values: words in subdivision types
PLAIN_CODES = ("none", "custom", "inpatient_or_day_hospital", "day_hospital_group")  # fixed values: conditions without a list


def norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def plan_rule(orgs: DataFrame, plan: DataFrame, plan_rules: DataFrame) -> DataFrame:
    """(organization, type) → plan_status: required when a linked section has volume, unknown when none is
    listed, not_required when all are zero and the rule says so.  ``listed`` counts linked sections.

    Pairs without a linked section are not materialized: absent means unknown.
    """
    g = plan.join(plan_rules, "sheet_code").groupBy("organization_oid", "type_id").agg(
        F.max("annual_value").alias("__max"), F.count(F.lit(1)).alias("listed"), F.bool_or("zero_means_not_required").alias("zero_means_not_required"))
    st = F.when(F.col("__max") > 0, "required").when(F.col("zero_means_not_required"), "not_required").otherwise("unknown")
    return g.join(orgs.select("organization_oid").distinct(), "organization_oid", "left_semi").select("organization_oid", "type_id", st.alias("plan_status"), "listed")


def drop_subsumed(rules: DataFrame, general_type: str = "Стационарный") -> DataFrame:
    """Drop a specific rule of a subdivision type when the same type has an unconditional required one."""
    plain = (F.col("subdivision_kind") == "") & (F.col("condition_code") == "none")
    wide = rules.filter((F.col("subdivision_type") == general_type) & plain & (F.col("requirement_status") == "required"))
    narrow = (F.col("subdivision_type") == general_type) & ~plain
    return rules.filter(~narrow).unionByName(rules.filter(narrow).join(wide.select("type_id").distinct(), "type_id", "left_anti").select(*rules.columns))


def license_code(condition: str) -> str:
    """``license_1080_1`` → ``1080.1``, '' for other conditions."""
    m = re.fullmatch(r"license_(\d{3,4})_(\d{1,2})", condition)
    return f"{m[1]}.{m[2]}" if m else ""


def directory_list(directory: DataFrame, conditions: Mapping[str, str]) -> DataFrame:
    """(condition_code, organization_oid) from an attribute directory: organization_oid, attributes map<string,boolean>.

    ``conditions`` maps a condition to its attribute.  A condition whose attribute is known to no
    organization is not covered and gives no rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("condition_code"), F.lit(a).alias("attribute")) for c, a in conditions.items()])
    rows = directory.select("organization_oid", "attributes", F.inline(pairs))
    return rows.filter(F.try_element_at("attributes", F.col("attribute"))).select("condition_code", "organization_oid")


def directory_override(comment_lists: DataFrame, directory_lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists in force, differences).  Where the directory covers a condition its list wins."""
    covered = directory_lists.select("condition_code").distinct()
    cols = ["condition_code", "organization_oid"]
    live = directory_lists.select(*cols).unionByName(comment_lists.join(covered, "condition_code", "left_anti").select(*cols)).distinct()
    diff = set_diff(comment_lists.join(covered, "condition_code", "left_semi"), directory_lists, cols)
    return live, diff


def rule_verdicts(rules: DataFrame, orgs: DataFrame, subdivisions: DataFrame, rule_lists: DataFrame, plan: DataFrame, plan_rules: DataFrame) -> DataFrame:
    """(rule, organization): verdict matched / not_matched / unknown and ``plan_absent``, one row for every pair.

    A listing of all pairs is for a coded workbook of at most 65,536 rules; ``rule_hits`` has no limit.  Until the last step
    an organization has one row for every 64 rules, with a bit for each decided one: single pairs are never shuffled.
    """
    numbered = _workbook(rules)
    # hits carry the number of the rule's row: rule_id may repeat
    at = F.expr("shiftleft(1L, CAST(__at % 64 AS INT))")
    bits = lambda verdict: F.bit_or(F.when(F.col("verdict") == verdict, at).otherwise(F.lit(0).cast("long")))
    packed = _hits(numbered, orgs, subdivisions, rule_lists, plan, plan_rules, ["__at"]).groupBy(
        F.col("organization_oid").alias("__org"), F.expr("CAST(__at DIV 64 AS INT)").alias("__of")).agg(bits("matched").alias("__matched"), bits("unknown").alias("__unknown"))
    coded = numbered.join(_zero(plan_rules), "type_id", "left").select(
        F.expr("CAST(__at DIV 64 AS INT)").alias("__block"), F.struct("__at", "rule_id", "type_id", "requirement_status", (_on_plan() & flag("__zero")).alias("__waivable")).alias("rule"))
    blocks = coded.groupBy("__block").agg(F.sort_array(F.collect_list("rule")).alias("rules")).agg(F.sort_array(F.collect_list(F.struct("__block", "rules"))).alias("b"))
    blocks = blocks.select(F.struct(F.col("b.__block").alias("no"), F.col("b.rules").alias("rules"))).scalar()
    present = plan.select("organization_oid", F.lit(True).alias("__present")).distinct()
    rows = orgs.select("organization_oid").distinct().join(present, "organization_oid", "left").withColumn("__block", F.explode(blocks["no"]))
    j = rows.join(packed, rows["organization_oid"].eqNullSafe(F.col("__org")) & (F.col("__block") == F.col("__of")), "left")
    j = j.select("organization_oid", "__present", "__matched", "__unknown", F.inline(F.get(blocks["rules"], F.col("__block"))))
    has = lambda name: F.getbit(F.coalesce(F.col(name), F.lit(0).cast("long")), F.expr("CAST(__at % 64 AS INT)")) == 1
    # who is absent from the plan has no status there either
    return j.select("rule_id", "organization_oid", "type_id", "requirement_status", F.when(has("__matched"), "matched").when(has("__unknown"), "unknown").otherwise("not_matched").alias("verdict"),
                    (F.col("__waivable") & ~flag("__present")).alias("plan_absent"))


def _workbook(rules: DataFrame, limit: int = 65_536) -> DataFrame:
    """The rules with the number ``__at`` of their row; fails, never cuts, when there are more than ``limit``."""
    cols = ["rule_id", "type_id", "requirement_status", "subdivision_type", "subdivision_kind", "condition_code", "excludes", "has_list", "from_directory", "grounds"]
    whole = rules.filter("rule_id IS NOT NULL").select(F.struct(*cols).alias("r")).limit(limit + 1).agg(F.sort_array(F.collect_list("r")).alias("a"))
    checked = F.when(F.size("a") > limit, F.raise_error(F.lit(f"more than {limit} rules")).cast(whole.schema["a"].dataType)).otherwise(F.col("a"))
    return whole.select(F.posexplode(checked).alias("__at", "r")).select("__at", "r.*")


def rule_hits(rules: DataFrame, orgs: DataFrame, subdivisions: DataFrame, rule_lists: DataFrame, plan: DataFrame, plan_rules: DataFrame) -> DataFrame:
    """The rows of ``rule_verdicts`` that are matched or unknown; a pair without a row is not matched.

    The pairs are looked up, not tried: by the subdivision pattern of the rule, by the resolved list of a rule that only its
    list can match, and by type where the plan requires it.  Organizations never meet the rest of the rules.
    """
    return _hits(rules, orgs, subdivisions, rule_lists, plan, plan_rules)


def _hits(rules: DataFrame, orgs: DataFrame, subdivisions: DataFrame, rule_lists: DataFrame, plan: DataFrame, plan_rules: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """``rule_hits`` with the columns ``kept`` of the rules."""
    known = orgs.select("organization_oid").distinct()
    by_plan = plan_rule(orgs, plan, plan_rules).drop("listed")
    coded = (_coded(rules).filter("rule_id IS NOT NULL").withColumn("__plan", _on_plan())
             .join(_resolved(rule_lists), "rule_id", "left").join(_zero(plan_rules), "type_id", "left"))
    listed_only = ~F.coalesce(F.col("condition_code").isin(*PLAIN_CODES), F.lit(False)) & ~flag("excludes") & (flag("from_directory") | (flag("has_list") & flag("__resolved")))
    # what the plan does not require is decided by the rule itself, unless the plan waives it for the whole type
    own = coded.filter(~(F.col("__plan") & flag("__zero"))).withColumn("__listed_only", listed_only)
    kinds = _kinds(subdivisions).join(known, "organization_oid", "left_semi")
    has = _patterns(kinds)
    generic = known.withColumns({"__type": F.lit(""), "__kind": F.lit("")})
    patterns = has.select("organization_oid", "__type", "__kind").filter("__type <> '' OR __kind <> ''").unionByName(generic)
    facts = patterns.join(_day_hospital(has), ["organization_oid", "__type"], "left").join(_inpatient(kinds), "organization_oid", "left")
    lists = rule_lists.select("rule_id", "organization_oid", F.lit(True).alias("__listed")).distinct()
    by_pattern = facts.join(own.filter("NOT __listed_only"), ["__type", "__kind"]).join(lists, ["rule_id", "organization_oid"], "left")
    by_list = lists.join(own.filter("__listed_only"), "rule_id").join(facts, ["organization_oid", "__type", "__kind"])
    out = ["rule_id", "organization_oid", "type_id", "requirement_status", "verdict", *kept]
    looked_up = by_pattern.unionByName(by_list).withColumn("verdict", _condition()).filter("verdict <> 'not_matched'").join(by_plan, ["organization_oid", "type_id"], "left")
    required = by_plan.filter("plan_status = 'required'").join(coded.filter("__plan"), "type_id").withColumn("verdict", F.lit("matched"))
    return looked_up.filter(~F.col("__plan") | (F.coalesce("plan_status", F.lit("unknown")) == "unknown")).select(*out).unionByName(required.select(*out))


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _condition() -> Column:
    """The verdict of a rule's condition where its subdivision pattern holds."""
    code = F.col("condition_code")
    orphan = flag("has_list") & ~flag("from_directory") & ~flag("__resolved")
    return (F.when(code == "none", "matched").when(code == "custom", "unknown")
            .when(code == "inpatient_or_day_hospital", F.when(flag("__inpatient"), "matched").otherwise("not_matched"))
            .when(code == "day_hospital_group", F.when(flag("__dayhosp"), "matched").otherwise("not_matched"))
            .when(~flag("from_directory") & ~flag("has_list"), "unknown").when(orphan & ~flag("excludes"), "unknown")
            .when(flag("excludes"), F.when(flag("__listed"), "not_matched").otherwise("matched"))
            .otherwise(F.when(flag("__listed"), "matched").otherwise("not_matched")))


def _coded(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"__type": norm(F.col("subdivision_type")), "__kind": norm(F.col("subdivision_kind"))})


def _kinds(subdivisions: DataFrame) -> DataFrame:
    subs = subdivisions.select("organization_oid", norm(F.col("subdivision_type")).alias("__st"), norm(F.col("subdivision_kind")).alias("__sk"),
                               F.lower(F.concat_ws(" ", "subdivision_kind", "name")).alias("__text"))
    day = F.contains("__text", F.lit(DAY)) & F.contains("__text", F.lit(HOSPITAL))
    return subs.groupBy("organization_oid", "__st", "__sk").agg(F.bool_or(day).alias("__day"))


def _patterns(kinds: DataFrame) -> DataFrame:
    """Each kind satisfies four patterns: exact, any kind, any type, anything; rules look theirs up by key."""
    patterns = F.array(*[F.struct(a.alias("__type"), b.alias("__kind")) for a in (F.col("__st"), F.lit("")) for b in (F.col("__sk"), F.lit(""))])
    return kinds.select("organization_oid", "__day", F.inline(patterns)).groupBy("organization_oid", "__type", "__kind").agg(
        F.bool_or("__day").alias("__pattern_day")).withColumn("__base", F.lit(True))


def _resolved(rule_lists: DataFrame) -> DataFrame:
    return rule_lists.select("rule_id", F.lit(True).alias("__resolved")).distinct()


def _on_plan() -> Column:
    return F.coalesce(F.array_contains("grounds", PLAN_GROUND), F.lit(False))


def _zero(plan_rules: DataFrame) -> DataFrame:
    return plan_rules.groupBy("type_id").agg(F.bool_or("zero_means_not_required").alias("__zero"))


def _day_hospital(patterns: DataFrame) -> DataFrame:
    return patterns.filter("__kind = ''").select("organization_oid", "__type", F.col("__pattern_day").alias("__dayhosp"))


def _inpatient(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("organization_oid").agg(F.bool_or((F.col("__st") == INPATIENT) | F.col("__day")).alias("__inpatient"))


def type_defaults(types: DataFrame, rules: DataFrame, plan_rules: DataFrame) -> DataFrame:
    """(type, requirement_status, missing_rule, closed_world, waivable): what holds where no cell is stored.

    A type without rules is unknown, any other not required (closed world).  ``waivable``: for organizations absent from
    the plan, a requirement of the plan is dropped.
    """
    plans = rules.filter("rule_id IS NOT NULL").join(_zero(plan_rules), "type_id", "left").groupBy("type_id").agg(F.bool_or(_on_plan() & F.coalesce("__zero", F.lit(False))).alias("waivable"), F.lit(True).alias("__has"))
    has = F.col("__has").isNotNull()
    return types.select("type_id").distinct().join(plans, "type_id", "left").select(
        "type_id", F.when(has, "not_required").otherwise("unknown").alias("requirement_status"), (~has).alias("missing_rule"), has.alias("closed_world"), F.coalesce("waivable", F.lit(False)).alias("waivable"))


def applicability_cells(hits: DataFrame) -> DataFrame:
    """(organization, type) that some rule decides: required when any required rule matches, else unknown when a rule is
    undecided, else not_required; ``evidence_rules`` counts the rules behind it.  All other pairs have their type's default."""
    m = F.col("verdict") == "matched"
    st = F.col("requirement_status")
    g = hits.groupBy("organization_oid", "type_id").agg(
        F.count_if(m & (st == "required")).alias("__req"), F.count_if((F.col("verdict") == "unknown") | (m & (st == "unknown"))).alias("__unk"),
        F.count_if(m & (st == "not_required")).alias("__not"), F.count_if(m).alias("__matched"))
    status = F.when(F.col("__req") > 0, "required").when(F.col("__unk") > 0, "unknown").otherwise("not_required")
    evidence = F.when(F.col("__req") > 0, F.col("__req")).when(F.col("__unk") > 0, F.col("__matched")).otherwise(F.col("__not"))
    return g.select("organization_oid", "type_id", status.alias("requirement_status"), evidence.cast("long").alias("evidence_rules"))


def applicability(types: DataFrame, orgs: DataFrame, rules: DataFrame, hits: DataFrame, plan: DataFrame, plan_rules: DataFrame) -> DataFrame:
    """Every (organization, type): its cell where one is stored, else the default of the type.  The product is formed in this
    last step only.  ``waived`` marks a requirement dropped because the organization is absent from the plan."""
    cells = applicability_cells(hits).withColumnRenamed("requirement_status", "__status")
    present = plan.select("organization_oid", F.lit(True).alias("__present")).distinct()
    everyone = orgs.select("organization_oid").distinct().join(present, "organization_oid", "left")
    j = grid(everyone, types, "type_id").join(type_defaults(types, rules, plan_rules), "type_id").join(cells, ["organization_oid", "type_id"], "left")
    stored = F.col("__status").isNotNull()
    status = F.coalesce("__status", "requirement_status")
    return j.select("organization_oid", "type_id", status.alias("requirement_status"), "missing_rule", (F.col("closed_world") & ~stored).alias("closed_world"),
                    (F.col("waivable") & F.col("__present").isNull() & (status == "not_required")).alias("waived"), F.coalesce("evidence_rules", F.lit(0).cast("long")).alias("evidence_rules"))

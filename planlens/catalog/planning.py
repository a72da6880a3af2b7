"""Indicators and planning.  Suppliers stand for organizations, brands for document types, years of the
ship date for periods, lines for documents, part types for plan sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import keyed, rnd
from ..functions.text import name_key
from ..operators.joins import grid
from ..operators.ordered import framed
from ..plans import applicability as A
from ..plans import coverage as V
from ..plans import indicators as I
from ..plans import registers as G
from ..plans import series as M
from .base import query

CONFIG = [{"indicator_id": "I1", "types": ["Brand#11", "Brand#12"], "aggregate": "sum", "sheets": ["ECONOMY"]},
          {"indicator_id": "I2", "types": ["Brand#21", "Brand#22"], "aggregate": "max", "additional": ["Brand#3"], "sheets": ["PROMO", "SMALL"]}]
THROUGH = 8

BASE = """WITH f AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS period_id, l_suppkey AS organization_oid, p_brand AS type_code, month(l_shipdate)::INT AS month, count(*) AS document_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
 tg AS (SELECT period_id, s_suppkey AS organization_oid FROM (SELECT DISTINCT period_id FROM f), supplier WHERE s_suppkey % 9 <> 0),
 pl AS (SELECT period_id, organization_oid, sheet_code, annual, CASE WHEN sheet_code <> 'SMALL' THEN floor(annual / 12) END AS mo FROM (SELECT CAST(year(l_shipdate) AS VARCHAR) AS period_id, l_suppkey AS organization_oid, p_type AS sheet_code, count(*)::DOUBLE AS annual FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2, 3)),
 ct AS (SELECT * FROM (VALUES ('I1', 'Brand#11', 'main'), ('I1', 'Brand#12', 'main'), ('I2', 'Brand#21', 'main'), ('I2', 'Brand#22', 'main'), ('I2', 'Brand#3', 'additional')) v(indicator_id, type_code, role)),
 cs AS (SELECT * FROM (VALUES ('I1', 'ECONOMY'), ('I2', 'PROMO'), ('I2', 'SMALL')) v(indicator_id, sheet_code)),
 fm AS (SELECT period_id, organization_oid, indicator_id, month, CASE WHEN indicator_id = 'I2' THEN coalesce(max(document_count) FILTER (role = 'main'), 0) ELSE coalesce(sum(document_count) FILTER (role = 'main'), 0) END + coalesce(sum(document_count) FILTER (role = 'additional'), 0) AS numerator FROM f JOIN ct USING (type_code) JOIN tg USING (period_id, organization_oid) GROUP BY 1, 2, 3, 4),
 nt AS (SELECT period_id, organization_oid, indicator_id, role, type_code, sum(document_count) AS n FROM f JOIN ct USING (type_code) JOIN tg USING (period_id, organization_oid) GROUP BY ALL),
 nu AS (SELECT period_id, organization_oid, indicator_id, (CASE WHEN indicator_id = 'I2' THEN coalesce(max(n) FILTER (role = 'main'), 0) ELSE coalesce(sum(n) FILTER (role = 'main'), 0) END + coalesce(sum(n) FILTER (role = 'additional'), 0))::DOUBLE AS num FROM nt GROUP BY 1, 2, 3),
 sp AS (SELECT period_id, organization_oid, sheet_code, coalesce(8 * mo, annual) AS cum, annual, mo IS NULL AND annual > 0 AS fb FROM pl JOIN tg USING (period_id, organization_oid)),
 de AS (SELECT period_id, organization_oid, indicator_id, sum(cum) AS cum, sum(annual) AS ann, bool_or(fb) AS fb FROM sp JOIN cs USING (sheet_code) GROUP BY 1, 2, 3),
 vv AS (SELECT period_id, indicator_id, organization_oid, coalesce(num, 0) AS numerator, CASE WHEN ann > 0 THEN cum END AS denominator, CASE WHEN ann > 0 THEN ann END AS annual_denominator, coalesce(fb, false) AS used_annual_fallback,
  CASE WHEN ann > 0 THEN 'calculated' WHEN num > 0 THEN 'no_approved_volume' ELSE 'not_participating' END AS status, CASE WHEN ann > 0 AND cum > 0 THEN round(coalesce(num, 0) / cum * 10000) / 100 END AS percent
  FROM (SELECT * FROM tg, (VALUES ('I1'), ('I2')) i(indicator_id)) LEFT JOIN nu USING (period_id, organization_oid, indicator_id) LEFT JOIN de USING (period_id, organization_oid, indicator_id)),
 ld AS (SELECT DISTINCT period_id, month FROM f WHERE month <> 5 AND NOT (period_id = '2000' AND month > 9)),
 mo AS (SELECT unnest(range(1, 13))::INT AS month),
 pm AS (SELECT period_id, organization_oid, indicator_id, month, CASE WHEN month < 12 THEN mo ELSE annual - 11 * mo END AS v FROM pl JOIN tg USING (period_id, organization_oid) JOIN cs USING (sheet_code), mo WHERE mo IS NOT NULL),
 pa AS (SELECT period_id, indicator_id, month, sum(v) AS plan FROM pm GROUP BY 1, 2, 3), fa AS (SELECT period_id, indicator_id, month, sum(numerator)::DOUBLE AS fact FROM fm GROUP BY 1, 2, 3),
 pt0 AS (SELECT period_id, indicator_id, month, CASE WHEN (period_id, indicator_id) IN (SELECT (period_id, indicator_id) FROM pm) THEN coalesce(plan, 0) END AS plan, CASE WHEN (period_id, month) IN (SELECT (period_id, month) FROM ld) THEN coalesce(fact, 0) END AS fact
  FROM (SELECT * FROM (SELECT DISTINCT period_id FROM tg), (VALUES ('I1'), ('I2')) i(indicator_id), mo) LEFT JOIN pa USING (period_id, indicator_id, month) LEFT JOIN fa USING (period_id, indicator_id, month)),
 pt AS (SELECT *, CASE WHEN plan > 0 THEN round(fact / plan * 10000) / 100 END AS ratio FROM pt0),
 po AS (SELECT period_id, indicator_id, organization_oid, month, plan, fact, CASE WHEN plan > 0 THEN round(fact / plan * 10000) / 100 END AS ratio FROM (
  SELECT g.period_id, g.indicator_id, g.organization_oid, g.month, CASE WHEN (g.period_id, g.indicator_id, g.organization_oid) IN (SELECT (period_id, indicator_id, organization_oid) FROM pm) THEN coalesce(p.plan, 0) END AS plan, CASE WHEN (g.period_id, g.month) IN (SELECT (period_id, month) FROM ld) THEN coalesce(numerator, 0)::DOUBLE END AS fact
  FROM (SELECT * FROM tg, (VALUES ('I1'), ('I2')) i(indicator_id), mo) g LEFT JOIN (SELECT period_id, indicator_id, organization_oid, month, sum(v) AS plan FROM pm GROUP BY 1, 2, 3, 4) p USING (period_id, indicator_id, organization_oid, month) LEFT JOIN fm USING (period_id, indicator_id, organization_oid, month))),
 sl AS (SELECT DISTINCT period_id, indicator_id, 3 AS a, 7 AS b, 40.0::DOUBLE AS ef FROM vv),
 ex AS (SELECT period_id, indicator_id, organization_oid, (organization_oid % 4)::DOUBLE AS case_fact FROM vv WHERE organization_oid % 6 <> 0),
 bd AS (SELECT po.period_id, po.indicator_id, po.organization_oid, max(case_fact) AS case_fact, coalesce(sum(fact) FILTER (month BETWEEN 3 AND 7), 0) AS docs, max(ratio) AS top, arg_min(month, {'a': -ratio, 'b': month}) FILTER (ratio IS NOT NULL) AS top_month FROM po LEFT JOIN ex USING (period_id, indicator_id, organization_oid) GROUP BY 1, 2, 3)
"""


def documents(t):
    return t.lineitem.join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey")).select(
        F.year("l_shipdate").cast("string").alias("period_id"), F.col("l_suppkey").alias("organization_oid"), F.col("p_brand").alias("type_code"),
        F.month("l_shipdate").alias("month"))


def months(t):
    return documents(t).groupBy("period_id", "organization_oid", "type_code", "month").agg(F.count(F.lit(1)).alias("document_count"))


def periods(t):
    return t.lineitem.select(F.year("l_shipdate").cast("string").alias("period_id")).distinct()


def targets(t):
    who = t.supplier.filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("organization_oid"))
    return grid(who, periods(t), "period_id").withColumn("through_month", F.lit(THROUGH))


def plans(t):
    g = t.lineitem.filter("l_suppkey % 5 <> 0").join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.year("l_shipdate").cast("string").alias("period_id"), F.col("l_suppkey").alias("organization_oid"), F.col("p_type").alias("sheet_code")).agg(
        F.count(F.lit(1)).cast("double").alias("annual_value"))
    m = F.floor(F.col("annual_value") / 12).cast("double")
    full = F.map_from_arrays(F.array(*[F.lit(i) for i in [*range(1, 13), 13]]), F.array(*[m] * 11, F.col("annual_value") - 11 * m, F.lit(99.0)))
    return g.withColumn("monthly_values", F.when(F.col("sheet_code") != "SMALL", full).otherwise(F.map_filter(full, lambda k, v: F.lit(False))))


def loaded(t):
    return documents(t).select("period_id", "month").distinct().filter("month <> 5 AND NOT (period_id = '2000' AND month > 9)")


def values(t):
    return I.plan_ratio(months(t), plans(t), targets(t), CONFIG)


def points(t, by_org=False):
    return M.monthly_series(months(t), plans(t), targets(t), CONFIG, loaded(t), by_org)


def slices(t):
    return periods(t).withColumn("indicator_id", F.explode(F.array(F.lit("I1"), F.lit("I2")))).withColumns(
        {"from_month": F.lit(3), "to_month": F.lit(7), "execution_fact": F.lit(40.0)})


def execution(t):
    return targets(t).filter("organization_oid % 6 <> 0").withColumn("indicator_id", F.explode(F.array(F.lit("I1"), F.lit("I2")))).withColumn(
        "case_fact", (F.col("organization_oid") % 4).cast("double"))


def breakdown(t):
    return M.org_breakdown(M.monthly_table(months(t), plans(t), targets(t), CONFIG, loaded(t), True), execution(t), slices(t))


# --- ratios -----------------------------------------------------------------------------------

RATIO_SRC = "SELECT o_orderkey, CASE WHEN o_custkey % 11 <> 0 THEN o_totalprice END AS numerator, (o_custkey - 50) * 1000.0::DOUBLE AS denominator, CASE WHEN o_orderkey % 13 <> 0 THEN 40.0::DOUBLE END AS target_value, CASE WHEN o_orderkey % 17 = 0 THEN 'in_development' ELSE 'approved' END AS ms, CASE WHEN o_orderkey % 3 = 0 THEN 25.0 WHEN o_orderkey % 3 = 1 THEN -1.0 END AS pts FROM orders"
RATIO = f"""WITH s AS ({RATIO_SRC}), r AS (SELECT *, CASE WHEN ms = 'in_development' THEN 'methodology_in_development' WHEN numerator IS NULL OR denominator <= 0 THEN 'awaiting_data' ELSE 'calculated' END AS status FROM s),
 v AS (SELECT *, CASE WHEN status = 'calculated' THEN round(numerator / denominator * 10000) / 100 END AS fact_value FROM r), d AS (SELECT *, round(fact_value - target_value, 2) AS deviation_value, CASE WHEN pts > 0 THEN pts ELSE 10 END AS lim FROM v)
SELECT o_orderkey, status, fact_value, deviation_value, CASE WHEN deviation_value IS NULL THEN 'not_assessed' WHEN deviation_value >= 0 THEN 'target_met' WHEN deviation_value <= -lim THEN 'critical' ELSE 'below_target' END AS business_status FROM d"""


def _ratio_rows(t):
    k = F.col("o_orderkey")
    return t.orders.select(k, F.when(F.col("o_custkey") % 11 != 0, F.col("o_totalprice")).alias("numerator"), ((F.col("o_custkey") - 50) * 1000.0).alias("denominator"),
                           F.when(k % 13 != 0, 40.0).alias("target_value"), F.when(k % 17 == 0, "in_development").otherwise("approved").alias("methodology_status"),
                           F.when(k % 3 == 0, 25.0).when(k % 3 == 1, -1.0).alias("pts"))


@query("ind1_ratio_percent", RATIO)
def _(t):
    return I.ratio_percent(_ratio_rows(t), "pts").select("o_orderkey", "status", "fact_value", "deviation_value", "business_status")


@query("ind2_assessment", "SELECT business_status, count(*) AS n FROM (" + RATIO + ") GROUP BY 1")
def _(t):
    return I.assess(I.ratio_percent(_ratio_rows(t)), points="pts").groupBy("business_status").agg(F.count(F.lit(1)).alias("n"))


@query("ind3_plan_ratio", BASE + "SELECT period_id, indicator_id, organization_oid, status, numerator, denominator, annual_denominator, used_annual_fallback, percent FROM vv")
def _(t):
    return values(t)


@query("ind4_numerators", BASE + "SELECT period_id, organization_oid, indicator_id, num AS numerator FROM nu")
def _(t):
    return I.numerators(months(t).join(keyed(targets(t)), ["period_id", "organization_oid"], "left_semi"), CONFIG)


@query("ind5_cumulative_plan", BASE + "SELECT period_id, organization_oid, sheet_code, cum AS cumulative_value, annual AS annual_value, fb AS used_annual_fallback FROM sp")
def _(t):
    return I.cumulative_plan(plans(t), targets(t))


@query("ind6_region", BASE + """SELECT period_id, indicator_id, sum(numerator) AS numerator, coalesce(sum(denominator), 0) AS denominator, coalesce(sum(annual_denominator), 0) AS annual_denominator, count(*) FILTER (used_annual_fallback) AS annual_fallback_organizations,
 count(*) AS organizations, count(*) FILTER (status = 'calculated') AS calculated, count(*) FILTER (status = 'no_approved_volume') AS no_approved_volume, count(*) FILTER (status = 'not_participating') AS not_participating,
 coalesce(sum(numerator) FILTER (annual_denominator IS NULL), 0) AS numerator_without_plan, round(sum(numerator) / sum(denominator) * 10000) / 100 AS percent FROM vv GROUP BY 1, 2""")
def _(t):
    return I.plan_ratio_region(values(t))


@query("ind6_type_breakdown", BASE + "SELECT period_id, indicator_id, type_code, CAST(sum(n) AS BIGINT) AS document_count FROM nt GROUP BY 1, 2, 3")
def _(t):
    return I.type_breakdown(months(t), targets(t), CONFIG)


@query("ind6_sheet_breakdown", BASE + "SELECT period_id, indicator_id, sheet_code, sum(cum) AS cumulative_value, sum(annual) AS annual_value, bool_or(fb) AS used_annual_fallback FROM sp JOIN cs USING (sheet_code) GROUP BY 1, 2, 3")
def _(t):
    return I.sheet_breakdown(plans(t), targets(t), CONFIG)


@query("ind7_overachieved", BASE + "SELECT period_id, indicator_id, organization_oid, 'volume_ratio_overachieved' AS finding_code, 'info' AS severity, numerator - denominator AS excess FROM vv WHERE status = 'calculated' AND percent > 100")
def _(t):
    return I.overachieved(values(t)).withColumn("excess", F.col("evidence.excess_documents")).drop("evidence")


N = "TRY_CAST(substr({}, 7) AS INT)"
REG = f"rg AS (SELECT DISTINCT p_brand AS type_id FROM part WHERE {N.format('p_brand')} <= 18), fp AS (SELECT period_id, organization_oid, type_code AS type_id, sum(document_count) AS d FROM f JOIN tg USING (period_id, organization_oid) GROUP BY 1, 2, 3 HAVING sum(document_count) > 1),"
REQ = f"""rq AS (SELECT period_id, organization_oid, type_id, CASE (organization_oid + {N.format('type_id')}) % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'not_required' WHEN 2 THEN 'required' ELSE 'unknown' END AS status FROM tg, (SELECT DISTINCT p_brand AS type_id FROM part) WHERE (organization_oid * 3 + {N.format('type_id')}) % 5 <> 0)"""


def brand_no(c="type_id"):
    return F.substring(c, 7, 9).try_cast("int")


def _reg_inputs(t):
    f = months(t).groupBy("period_id", "organization_oid", F.col("type_code").alias("type_id")).agg(F.sum("document_count").alias("document_count")).filter("document_count > 1")
    reg = t.part.select(F.col("p_brand").alias("type_id")).distinct().filter(brand_no() <= 18)
    pairs = grid(targets(t).select("period_id", "organization_oid"), t.part.select(F.col("p_brand").alias("type_id")), "type_id")
    m = (F.col("organization_oid") + brand_no()) % 4
    req = pairs.filter((F.col("organization_oid") * 3 + brand_no()) % 5 != 0).withColumn("status", F.when(m.isin(0, 2), "required").when(m == 1, "not_required").otherwise("unknown"))
    return f, reg, targets(t), req


@query("ind8_type_coverage", BASE + "," + REG[:-1] + """ SELECT period_id, organization_oid, count(fp.type_id) AS registered_types, round(count(fp.type_id) / (SELECT count(*) FROM rg) * 10000) / 100 AS percent, count(fp.type_id) - count(rg.type_id) AS types_outside_registry
 FROM tg LEFT JOIN fp USING (period_id, organization_oid) LEFT JOIN rg ON rg.type_id = fp.type_id GROUP BY 1, 2""")
def _(t):
    f, reg, tg, _ = _reg_inputs(t)
    return I.type_coverage(f, reg, tg)


@query("ind8_type_coverage_region", BASE + "," + REG[:-1] + """ SELECT period_id, count(DISTINCT fp.type_id) AS registered_types, round(count(DISTINCT fp.type_id) / (SELECT count(*) FROM rg) * 10000) / 100 AS percent, count(DISTINCT fp.type_id) - count(DISTINCT rg.type_id) AS types_outside_registry,
 (SELECT count(*) FROM tg x WHERE x.period_id = tg.period_id AND (period_id, organization_oid) NOT IN (SELECT (period_id, organization_oid) FROM fp WHERE type_id IN (FROM rg))) AS organizations_without_registration
 FROM tg LEFT JOIN fp USING (period_id, organization_oid) LEFT JOIN rg ON rg.type_id = fp.type_id GROUP BY 1""")
def _(t):
    f, reg, tg, _ = _reg_inputs(t)
    return I.type_coverage_region(f, reg, tg)


@query("ind8_registry_types", BASE + "," + REG[:-1] + """, p AS (SELECT period_id, type_id, count(*) AS organizations, CAST(sum(d) AS BIGINT) AS documents FROM fp GROUP BY 1, 2), g AS (SELECT period_id, type_id FROM (SELECT DISTINCT period_id FROM tg), rg)
 SELECT coalesce(g.period_id, p.period_id) AS period_id, coalesce(g.type_id, p.type_id) AS type_id, CASE WHEN g.type_id IS NULL THEN 'outside_registry' WHEN organizations > 0 THEN 'registered' ELSE 'not_registered' END AS status, coalesce(organizations, 0) AS organizations, coalesce(documents, 0) AS documents
 FROM g FULL JOIN p ON g.period_id = p.period_id AND g.type_id = p.type_id""")
def _(t):
    f, reg, tg, _ = _reg_inputs(t)
    return I.registry_types(f, reg, tg)


@query("ind9_plan_execution", BASE + "," + REG + REQ + """ SELECT period_id, organization_oid, count(*) FILTER (status = 'required') AS required_types, count(*) FILTER (status = 'required' AND d IS NOT NULL) AS registered_required_types, count(*) FILTER (status = 'unknown') AS undefined_types,
 CASE WHEN count(*) FILTER (status = 'required') > 0 THEN round(count(*) FILTER (status = 'required' AND d IS NOT NULL) / count(*) FILTER (status = 'required') * 10000) / 100 END AS plan_percent
 FROM tg LEFT JOIN (SELECT * FROM rq WHERE type_id IN (FROM rg)) q USING (period_id, organization_oid) LEFT JOIN fp USING (period_id, organization_oid, type_id) GROUP BY 1, 2""")
def _(t):
    f, reg, tg, req = _reg_inputs(t)
    return I.type_coverage(f, reg, tg, req).select("period_id", "organization_oid", "required_types", "registered_required_types", "undefined_types", "plan_percent")


@query("ind10_prior_year", BASE + """, y AS (SELECT period_id::INT AS y, type_code AS type_id, CAST(sum(document_count) AS BIGINT) AS documents, count(DISTINCT organization_oid) AS organizations FROM f WHERE period_id <> '1997' GROUP BY 1, 2),
 l AS (SELECT period_id, max(y) AS y FROM (SELECT DISTINCT period_id FROM f), (SELECT DISTINCT y FROM y) WHERE y < period_id::INT GROUP BY 1) SELECT period_id, y AS reporting_year, type_id, documents, organizations FROM l JOIN y USING (y)""")
def _(t):
    annual = months(t).filter("period_id <> '1997'").select(F.col("period_id").cast("int").alias("reporting_year"), "organization_oid", F.col("type_code").alias("type_id"), "document_count")
    return I.prior_year(annual, periods(t).withColumn("year", F.col("period_id").cast("int")))


# --- monthly series -----------------------------------------------------------------------------

@query("ind11_monthly_series", BASE + "SELECT period_id, indicator_id, month, plan, fact, ratio FROM pt")
def _(t):
    return points(t)


@query("ind12_registry_series", BASE + "SELECT period_id, month, CASE WHEN (period_id, month) IN (SELECT (period_id, month) FROM ld) THEN coalesce(n, 0) END AS fact FROM (SELECT * FROM (SELECT DISTINCT period_id FROM tg), mo) LEFT JOIN (SELECT period_id, month, CAST(sum(document_count) AS BIGINT) AS n FROM f JOIN tg USING (period_id, organization_oid) GROUP BY 1, 2) USING (period_id, month)")
def _(t):
    return M.registry_series(documents(t).withColumn("document_count", F.lit(1)), targets(t), loaded(t))


@query("ind12_type_counts", BASE + "SELECT period_id, month, count(DISTINCT type_code) AS unique_types FROM f JOIN tg USING (period_id, organization_oid) GROUP BY 1, 2")
def _(t):
    return M.type_count_series(months(t), targets(t))


@query("ind13_execution_summary", BASE + """SELECT period_id, indicator_id, a AS from_month, b AS to_month, coalesce(sum(plan), 0) AS plan_value, ef AS fact_value, coalesce(sum(fact), 0) AS document_value, round(coalesce(sum(fact), 0) / ef * 10000) / 100 AS percent_of_fact, count(*) FILTER (fact IS NULL) AS missing
 FROM pt JOIN sl USING (period_id, indicator_id) WHERE month BETWEEN a AND b GROUP BY period_id, indicator_id, a, b, ef""")
def _(t):
    return M.execution_summary(points(t), slices(t)).withColumn("missing", F.size("missing_months").cast("long")).drop("missing_months")


@query("ind14_org_breakdown", BASE + "SELECT period_id, indicator_id, organization_oid, top AS top_ratio, case_fact, docs AS documents_in_slice, CASE WHEN case_fact > 0 THEN round(docs / case_fact * 10000) / 100 END AS percent_of_fact FROM bd")
def _(t):
    return breakdown(t).withColumn("top_ratio", F.array_max("monthly_ratios")).drop("monthly_ratios")


# --- type coverage of organizations -----------------------------------------------------------------

PILOT = BASE + f""", ty AS (SELECT type_id, n, n <> 7 AS ref, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS rv, n % 8 = 0 AS dv FROM (SELECT DISTINCT p_brand AS type_id, {N.format('p_brand')} AS n FROM part)),
 tt AS (SELECT type_id, n FROM ty WHERE ref AND coalesce(rv, dv)),
 fo AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS period_id, l_suppkey AS organization_oid, p_brand AS type_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40),
 fr AS (SELECT DISTINCT CAST(year(l_shipdate) AS VARCHAR) AS period_id, p_brand AS type_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) < 1998 AND l_quantity > 49 AND l_discount > 0.08),
 ft AS (FROM fr UNION SELECT period_id, type_id FROM fo WHERE period_id NOT IN (SELECT period_id FROM fr)),
 rr AS (SELECT period_id, organization_oid, type_id, CASE (organization_oid + n) % 5 WHEN 0 THEN 'required' WHEN 1 THEN 'required' WHEN 2 THEN 'not_required' WHEN 3 THEN 'not_required' ELSE CASE WHEN organization_oid % 7 = 0 THEN 'unknown' ELSE 'required' END END AS st,
  CASE (organization_oid + n) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS av, organization_oid % 11 = 0 AS man FROM tg, tt WHERE NOT (organization_oid % 4 = 0 AND n % 5 = 0)),
 pr AS (SELECT tg.period_id, tg.organization_oid, tt.type_id, coalesce(st, 'missing') AS requirement_status, fo.type_id IS NOT NULL AS registered, av AS available, coalesce(man, false) AS is_manual, tt.n % 6 = 0 AS external
  FROM (tg CROSS JOIN tt) LEFT JOIN rr ON rr.period_id = tg.period_id AND rr.organization_oid = tg.organization_oid AND rr.type_id = tt.type_id LEFT JOIN fo ON fo.period_id = tg.period_id AND fo.organization_oid = tg.organization_oid AND fo.type_id = tt.type_id),
 ps AS (SELECT *, CASE requirement_status WHEN 'required' THEN CASE WHEN registered THEN 'required_registered' WHEN NOT available THEN 'required_unavailable' WHEN available THEN 'required_missing' ELSE 'required_unknown' END
  WHEN 'not_required' THEN CASE WHEN registered THEN 'not_required_registered' ELSE 'not_required' END ELSE CASE WHEN registered THEN 'unknown_registered' ELSE 'unknown' END END AS pair_status FROM pr),
 og AS (SELECT period_id, organization_oid, count(*) FILTER (requirement_status = 'required') AS req, count(*) FILTER (requirement_status = 'missing') AS mis, count(*) FILTER (requirement_status = 'unknown') AS unk, count(*) FILTER (pair_status = 'required_registered') AS act,
  count(*) FILTER (pair_status = 'required_unavailable') AS blocked, count(*) FILTER (pair_status = 'required_missing' AND NOT external) AS missing_at_organization, count(*) FILTER (pair_status = 'required_missing' AND external) AS handled_externally, count(*) FILTER (pair_status = 'not_required_registered') AS unexpected FROM ps GROUP BY 1, 2),
 oc AS (SELECT *, mis = 0 AND unk = 0 AS complete FROM og)
"""


def pilot_inputs(t):
    n = brand_no()
    types = t.part.select(F.col("p_brand").alias("type_id")).distinct().select(
        "type_id", F.col("type_id").alias("name"), (n != 7).alias("in_reference"), F.when(n % 4 == 1, False).when(n % 4 != 0, True).alias("registry_visible"), (n % 8 == 0).alias("reference_visible"))
    lines = t.lineitem.join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey")).select(F.year("l_shipdate").cast("string").alias("period_id"), F.col("l_suppkey").alias("organization_oid"), F.col("p_brand").alias("type_id"), "l_quantity", "l_discount")
    org = lines.filter("l_quantity > 40").select("period_id", "organization_oid", "type_id", F.lit(1).cast("long").alias("document_count"), F.lit("organization").alias("scope_level"))
    reg = lines.filter("period_id < '1998' AND l_quantity > 49 AND l_discount > 0.08").groupBy("period_id", "type_id").agg(F.count(F.lit(1)).alias("document_count")).withColumns(
        {"scope_level": F.lit("region"), "organization_oid": F.lit(None).cast("long")})
    facts = org.unionByName(reg)
    tg = targets(t).drop("through_month")
    pairs = grid(tg, V.target_types(types), "type_id").filter(~((F.col("organization_oid") % 4 == 0) & (n % 5 == 0)))
    m, a = (F.col("organization_oid") + n) % 5, (F.col("organization_oid") + n) % 3
    req = pairs.withColumns({"requirement_status": F.when(m.isin(2, 3), "not_required").when((m == 4) & (F.col("organization_oid") % 7 == 0), "unknown").otherwise("required"),
                             "available": F.when(a == 0, True).when(a == 1, False), "is_manual": F.col("organization_oid") % 11 == 0})
    external = types.filter(n % 6 == 0).select("type_id")
    return types, facts, tg, req, external


def pilot_pairs(t):
    types, facts, tg, req, external = pilot_inputs(t)
    return V.classify_pairs(types, facts, tg, req, external)


def pilot_orgs(t):
    types, facts, tg, req, external = pilot_inputs(t)
    return V.assess_org(V.packed_counts(types, facts, tg, req, external), V.readiness(types, facts, periods(t)))


@query("ind15_regional_coverage", PILOT + """, a AS (SELECT period_id, count(*) FILTER (type_id IN (SELECT type_id FROM tt)) AS actual_types FROM ft GROUP BY 1)
 SELECT period_id, 'ready' AS readiness, actual_types, (SELECT count(*) FROM tt) AS planned_types, round(actual_types / (SELECT count(*) FROM tt) * 10000) / 100 AS coverage_percent, actual_types - 12 AS deviation_value,
 CASE WHEN actual_types >= 12 THEN 'target_met' WHEN actual_types - 12 <= -10 THEN 'critical' ELSE 'below_target' END AS business_status FROM a""")
def _(t):
    types, facts, *_ = pilot_inputs(t)
    return V.pilot_region(types, facts, periods(t), target=12)


@query("ind16_organization_coverage", PILOT + """SELECT period_id, organization_oid, CASE WHEN NOT complete THEN 'applicability_incomplete' WHEN req = 0 THEN 'not_applicable' ELSE 'ready' END AS readiness, NOT complete AND req > 0 AS is_preliminary,
 CASE WHEN complete OR req > 0 THEN act END AS actual_types, CASE WHEN complete OR req > 0 THEN req END AS planned_types, CASE WHEN req > 0 THEN round(act / req * 10000) / 100 END AS coverage_percent, blocked, missing_at_organization, handled_externally, unexpected,
 CASE WHEN NOT complete THEN CASE WHEN req > 0 THEN 'calculated' ELSE 'awaiting_data' END WHEN req = 0 THEN 'not_calculated' ELSE 'calculated' END AS status,
 CASE WHEN NOT complete OR req = 0 THEN 'not_assessed' WHEN act >= req THEN 'target_met' WHEN act - req <= -greatest(1, ceil(req * 0.25)) THEN 'critical' ELSE 'below_target' END AS business_status, CASE WHEN complete AND req > 0 THEN act - req END AS deviation_value FROM oc""")
def _(t):
    return pilot_orgs(t).select("period_id", "organization_oid", "readiness", "is_preliminary", "actual_types", "planned_types", "coverage_percent", "blocked", "missing_at_organization",
                                "handled_externally", "unexpected", "status", "business_status", "deviation_value")


@query("ind17_readiness", PILOT + "SELECT DISTINCT period_id, CASE WHEN period_id IN (SELECT period_id FROM fo WHERE period_id < '1997') THEN 'ready' ELSE 'data_missing' END AS readiness, (SELECT count(*) FROM ty WHERE ref) AS catalog, 0 AS unknown, (SELECT count(*) FROM ty WHERE ref AND coalesce(rv, dv)) AS available FROM tg")
def _(t):
    types, facts, *_ = pilot_inputs(t)
    return V.readiness(types, facts.filter("period_id < '1997'"), periods(t))


@query("ind17_readiness_incomplete", PILOT + "SELECT DISTINCT period_id, CASE WHEN period_id IN (SELECT period_id FROM fo UNION ALL SELECT period_id FROM fr) THEN 'reference_incomplete' ELSE 'data_missing' END AS readiness, (SELECT count(*) FROM ty WHERE ref) AS catalog, (SELECT count(*) FROM ty WHERE ref AND n % 4 = 0) AS unknown, (SELECT count(*) FROM ty WHERE ref AND rv) AS available FROM tg")
def _(t):
    types, facts, *_ = pilot_inputs(t)
    return V.readiness(types.withColumn("reference_visible", F.lit(None).cast("boolean")), facts, periods(t))


@query("ind18_pair_status", PILOT + "SELECT period_id, organization_oid, type_id, requirement_status, registered, available, is_manual, external, pair_status FROM ps")
def _(t):
    return pilot_pairs(t)


PAIR_FINDINGS = """, pf AS (SELECT period_id, organization_oid, type_id, CASE WHEN pair_status = 'required_unavailable' THEN 'type_not_implemented' WHEN pair_status = 'required_missing' AND external THEN 'type_handled_in_external_system' WHEN pair_status = 'required_missing' THEN 'required_type_not_registered'
 WHEN pair_status = 'required_unknown' THEN 'capability_unknown' WHEN pair_status = 'not_required_registered' THEN 'registered_when_not_required' END AS finding_code FROM ps),
 ff AS (SELECT period_id, organization_oid, type_id, finding_code FROM pf WHERE finding_code IS NOT NULL UNION ALL SELECT period_id, organization_oid, NULL, 'applicability_incomplete' FROM oc WHERE NOT complete
 UNION ALL SELECT period_id, NULL, type_id, 'visibility_source_mismatch' FROM (SELECT DISTINCT period_id FROM tg), ty WHERE rv IS NOT NULL AND dv IS NOT NULL AND rv <> dv
 UNION ALL SELECT DISTINCT period_id, NULL, type_id, 'capability_contradicts_facts' FROM fo WHERE (SELECT n FROM ty WHERE ty.type_id = fo.type_id) % 10 = 3)
"""


def pilot_findings(t):
    types, facts, tg, req, external = pilot_inputs(t)
    pairs = V.classify_pairs(types, facts, tg, req, external)
    orgs = V.pilot_org(pairs, V.readiness(types, facts, periods(t)))
    directory = types.select("type_id", (brand_no() % 10 != 3).alias("available"))
    return V.all_findings(V.pair_findings(pairs, orgs), V.source_mismatch_findings(types, periods(t)), V.capability_conflicts(facts, directory))


REASON_ROWS = ", ".join(f"('{code}', '{cause}', '{advice}')" for code, (cause, advice) in V.REASONS.items())


@query("ind19_findings", PILOT + PAIR_FINDINGS + f"SELECT period_id, CAST(organization_oid AS VARCHAR) AS organization_oid, type_id, finding_code, cause, recommendation FROM ff JOIN (VALUES {REASON_ROWS}) w(code, cause, recommendation) ON code = finding_code")
def _(t):
    return pilot_findings(t).select("period_id", "organization_oid", "type_id", "finding_code", "cause", "recommendation")


PAIR_EVIDENCE = PILOT + """, pe AS (SELECT *, CASE WHEN pair_status = 'required_unavailable' THEN 'type_not_implemented' WHEN pair_status = 'required_missing' AND external THEN 'type_handled_in_external_system' WHEN pair_status = 'required_missing' THEN 'required_type_not_registered'
 WHEN pair_status = 'required_unknown' THEN 'capability_unknown' WHEN pair_status = 'not_required_registered' THEN 'registered_when_not_required' END AS finding_code FROM ps),
 ev AS (SELECT period_id, finding_code, unnest(['requirement_status', 'registered', 'available', 'external', 'is_manual']) AS name, unnest([requirement_status, CAST(registered AS VARCHAR), CAST(available AS VARCHAR), CAST(external AS VARCHAR), CAST(is_manual AS VARCHAR)]) AS value
  FROM pe WHERE finding_code IS NOT NULL)
"""


@query("ind20_finding_evidence", PAIR_EVIDENCE + "SELECT period_id, finding_code, name, value, count(*) AS n FROM ev WHERE value IS NOT NULL GROUP BY ALL UNION ALL SELECT period_id, 'applicability_incomplete', name, CAST(value AS VARCHAR), count(*) FROM "
       + "(SELECT period_id, unnest(['required', 'missing_rules', 'unknown_rules']) AS name, unnest([req, mis, unk]) AS value FROM oc WHERE NOT complete) GROUP BY ALL")
def _(t):
    types, facts, tg, req, external = pilot_inputs(t)
    pairs = V.classify_pairs(types, facts, tg, req, external)
    found = V.pair_findings(pairs, V.pilot_org(pairs, V.readiness(types, facts, periods(t))))
    return V.finding_evidence(found, ["period_id", "finding_code"])


@query("ind19_data_quality", PILOT + """SELECT period_id, NULL AS organization_oid, 'document_type_unmapped' AS finding_code FROM (SELECT DISTINCT period_id FROM f) UNION ALL SELECT DISTINCT period_id, NULL, 'organization_not_in_directory' FROM f WHERE organization_oid = 9
 UNION ALL SELECT DISTINCT period_id, NULL, 'subdivision_not_in_directory' FROM f WHERE organization_oid % 9 = 0 UNION ALL SELECT '1999', NULL, 'applicability_matrix_not_loaded' UNION ALL SELECT DISTINCT period_id, CAST(organization_oid AS VARCHAR), 'organization_without_subdivisions' FROM tg WHERE organization_oid % 30 = 1""")
def _(t):
    m = months(t)
    names = m.filter("type_code = 'Brand#1'").select("period_id", F.col("type_code").alias("name")).unionByName(m.select("period_id", F.lit("other").alias("name")))
    orgs = m.filter("organization_oid = 9").select("period_id", "organization_oid").distinct()
    subs = m.filter("organization_oid % 9 = 0").groupBy("period_id", F.col("organization_oid").alias("oid")).agg(F.sum("document_count").alias("document_count"))
    rules = periods(t).withColumn("rules", F.when(F.col("period_id") == "1999", 0).otherwise(3))
    bare = targets(t).filter("organization_oid % 30 = 1")
    return V.data_quality_findings(names, orgs, subs, rules, bare).select("period_id", "organization_oid", "finding_code")


@query("ind20_grouped_findings", PILOT + PAIR_FINDINGS + "SELECT period_id, finding_code, count(*) AS finding_count, count(DISTINCT organization_oid) AS organizations, count(DISTINCT type_id) AS types FROM ff GROUP BY 1, 2")
def _(t):
    return V.group_findings(pilot_findings(t)).select("period_id", "finding_code", "finding_count", "organizations", "types")


@query("ind20_finding_members", PILOT + PAIR_FINDINGS + "SELECT DISTINCT period_id, finding_code, 'organization' AS kind, CAST(organization_oid AS VARCHAR) AS member FROM ff WHERE organization_oid IS NOT NULL UNION ALL SELECT DISTINCT period_id, finding_code, 'type', type_id FROM ff WHERE type_id IS NOT NULL")
def _(t):
    return V.finding_members(pilot_findings(t)).drop("responsibility_area", "cause", "recommendation")


# --- registers and imports ------------------------------------------------------------------------

REGISTER = BASE + """, rg AS (SELECT period_id, organization_oid, organization_oid * 10 + b AS building_id, CASE WHEN b = 2 THEN 0 ELSE 1 END AS plan_value, CAST((organization_oid + b) % 2 AS INT) AS fact_value FROM tg, (VALUES (0), (1), (2)) x(b)),
 bf AS (SELECT period_id, CASE WHEN organization_oid % 2 = 0 THEN 'cumulative' ELSE 'month' END AS coverage, month, organization_oid * 10 + document_count % 3 AS building_id FROM f WHERE period_id <> '1996'),
 ls AS (SELECT DISTINCT period_id, building_id FROM bf b WHERE coverage = 'cumulative' AND month = (SELECT max(month) FROM bf c WHERE c.period_id = b.period_id AND c.coverage = 'cumulative')),
 mk AS (SELECT *, period_id IN (SELECT period_id FROM ls) AS has, CASE WHEN period_id IN (SELECT period_id FROM ls) THEN (period_id, building_id) IN (SELECT (period_id, building_id) FROM ls) ELSE fact_value > 0 END AS t FROM rg)
"""


def register_inputs(t):
    b = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    reg = targets(t).drop("through_month").withColumn("b", b).select(
        "period_id", "organization_oid", (F.col("organization_oid") * 10 + F.col("b")).alias("building_id"), F.when(F.col("b") == 2, 0).otherwise(1).alias("plan_value"),
        ((F.col("organization_oid") + F.col("b")) % 2).cast("int").alias("fact_value"))
    facts = months(t).filter("period_id <> '1996'").select("period_id", F.when(F.col("organization_oid") % 2 == 0, "cumulative").otherwise("month").alias("coverage"), "month",
                                                          (F.col("organization_oid") * 10 + F.col("document_count") % 3).alias("building_id"), "document_count")
    return reg, facts


@query("ind21_register_coverage", REGISTER + """SELECT period_id, n AS numerator, d AS denominator, round(n / d * 10000) / 100 AS percent, organizations, register_fact FROM (SELECT period_id, CAST(CASE WHEN bool_or(has) THEN count(*) FILTER (plan_value > 0 AND t) ELSE sum(fact_value) END AS BIGINT) AS n, CAST(sum(plan_value) AS BIGINT) AS d,
 count(DISTINCT organization_oid) AS organizations, CAST(sum(fact_value) AS BIGINT) AS register_fact FROM mk GROUP BY 1)""")
def _(t):
    return G.register_coverage(*register_inputs(t))


@query("ind21_register_by_org", REGISTER + "SELECT period_id, organization_oid, CAST(sum(plan_value) AS BIGINT) AS denominator, count(*) FILTER (t) AS numerator, count(*) AS buildings, round(count(*) FILTER (t) / sum(plan_value) * 10000) / 100 AS percent FROM mk GROUP BY 1, 2")
def _(t):
    return G.register_by_org(*register_inputs(t))


@query("ind21_missing_buildings", REGISTER + "SELECT period_id, organization_oid, building_id FROM mk WHERE plan_value > 0 AND NOT t")
def _(t):
    return G.missing_buildings(*register_inputs(t))


LINES = "SELECT l_suppkey AS organization_oid, upper(p_brand) || ' «' || p_type || '»' AS nm, lower(p_brand || '_' || p_type) AS k, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS b, l_orderkey * 100 + l_linenumber AS row_no, 'House ' || l_quantity::INT AS bn, l_partkey || ' Main St' AS ba FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 9 <> 0"


def interval_inputs(t):
    name = F.concat(F.upper("p_brand"), F.lit(" «"), "p_type", F.lit("»"))
    rows = t.lineitem.join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("organization_oid"), name.alias("document_type_name"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linenumber").cast("string")).alias("building_id"), F.lit(1).alias("document_count"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"), F.concat(F.lit("House "), F.col("l_quantity").cast("int")).alias("building_name"), F.concat("l_partkey", F.lit(" Main St")).alias("building_address"))
    aliases = t.part.filter("p_type <> 'PROMO'").select(F.concat_ws(" ", "p_brand", "p_type").alias("alias"), F.concat_ws("/", "p_brand", "p_type").alias("type_id")).distinct()
    who = t.supplier.filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("organization_oid"))
    return rows, who, who.filter("organization_oid % 10 <> 0"), aliases, name_key


@query("ind22_interval_facts", f"SELECT organization_oid, split_part(nm, ' ', 1) AS brand, split_part(split_part(nm, '«', 2), '»', 1) AS part_type, count(*) AS document_count FROM ({LINES}) WHERE organization_oid % 10 <> 0 AND nm NOT LIKE '%PROMO%' GROUP BY 1, 2, 3")
def _(t):
    out = G.aggregate_interval(*interval_inputs(t))
    return out.select("organization_oid", F.upper(F.split("type_id", "/")[0]).alias("brand"), F.split("type_id", "/")[1].alias("part_type"), "document_count")


@query("ind22_building_facts", f"SELECT organization_oid, b AS building_id, split_part(nm, ' ', 1) AS brand, split_part(split_part(nm, '«', 2), '»', 1) AS part_type, count(*) AS document_count, arg_min(bn, (row_no, bn, ba)) AS building_name, arg_min(ba, (row_no, bn, ba)) AS building_address FROM ({LINES}) WHERE organization_oid % 10 <> 0 AND nm NOT LIKE '%PROMO%' AND b <> '' GROUP BY 1, 2, 3, 4")
def _(t):
    rows, *others = interval_inputs(t)
    ordered = rows.withColumn("row_no", F.struct("row_no", "building_name", "building_address"))  # a line number may occur twice in an order
    out = G.aggregate_interval(ordered, *others, by_building=True, order_by="row_no")
    return out.select("organization_oid", "building_id", "building_name", "building_address", F.upper(F.split("type_id", "/")[0]).alias("brand"), F.split("type_id", "/")[1].alias("part_type"), "document_count")


@query("ind22_unmatched", f"SELECT DISTINCT 'organization' AS kind, CAST(organization_oid AS VARCHAR) AS value FROM ({LINES}) WHERE organization_oid % 10 = 0 UNION ALL SELECT DISTINCT 'document_type', nm FROM ({LINES}) WHERE organization_oid % 10 <> 0 AND nm LIKE '%PROMO%'")
def _(t):
    return G.unmatched(*interval_inputs(t))


@query("ind23_interval_class", """WITH d AS (SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS a, (o_orderdate + to_days((o_custkey % 200)::INT))::DATE AS b FROM orders),
 k AS (SELECT *, year(a) = year(b) AND day(a) = 1 AND month(b) >= month(a) AS ok FROM d)
SELECT o_orderkey, CASE WHEN ok AND month(a) = month(b) THEN 'month' WHEN ok AND month(a) = 1 THEN 'cumulative' END AS coverage, CASE WHEN ok AND (month(a) = month(b) OR month(a) = 1) THEN month(b) END AS month, CASE WHEN ok AND (month(a) = month(b) OR month(a) = 1) THEN year(b) END AS year FROM k""")
def _(t):
    a = F.date_add(F.trunc(F.to_date("o_orderdate"), "month"), F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    b = F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 200).cast("int"))
    return G.interval_class(t.orders.select("o_orderkey", a.alias("from_date"), b.alias("to_date"))).drop("from_date", "to_date")


@query("ind24_reconcile", """WITH l AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS period_id, l_suppkey AS o, l_returnflag AS r, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), x AS (SELECT period_id, CAST(sum(n) AS BIGINT) AS c, CAST(sum(n) FILTER (o <> 3) AS BIGINT) AS i, CAST(sum(n) FILTER (r <> 'A') AS BIGINT) AS s FROM l GROUP BY 1)
SELECT period_id, 'region_total_vs_columns' AS "check", c AS expected, c AS actual, 'passed' AS status, 'warning' AS severity FROM x UNION ALL SELECT period_id, 'region_vs_institutions', c, i, CASE WHEN c = i THEN 'passed' ELSE 'failed' END, 'error' FROM x
UNION ALL SELECT period_id, 'region_vs_subdivisions', c, c, 'passed', 'error' FROM x UNION ALL SELECT period_id, 'institution_totals_vs_columns', i, i, 'passed', 'warning' FROM x UNION ALL SELECT period_id, 'subdivision_totals_vs_columns', c, s, CASE WHEN c = s THEN 'passed' ELSE 'failed' END, 'warning' FROM x
UNION ALL SELECT period_id, 'region_columns_vs_institution_columns', c, i, CASE WHEN c = i THEN 'passed' ELSE 'failed' END, 'warning' FROM x UNION ALL SELECT period_id, 'region_columns_vs_subdivision_columns', c, s, CASE WHEN c = s THEN 'passed' ELSE 'failed' END, 'warning' FROM x""")
def _(t):
    l = t.lineitem.groupBy(F.year("l_shipdate").cast("string").alias("period_id"), F.col("l_suppkey").alias("o"), F.col("l_returnflag").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    level = lambda d, name: d.withColumn("level", F.lit(name))
    columns = level(l, "region").unionByName(level(l.filter("o <> 3"), "institution")).unionByName(level(l.filter("r <> 'A'"), "subdivision")).withColumnRenamed("n", "count")
    totals = level(l, "region").unionByName(level(l.filter("o <> 3"), "institution")).unionByName(level(l, "subdivision")).withColumnRenamed("n", "declared_total")
    return G.reconcile(totals, columns)


@query("ind25_quality_issues", """WITH l AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS period_id, o_custkey FROM orders) SELECT period_id, 'duplicate_id' AS code, CAST(o_custkey AS VARCHAR) AS subject, CAST(1 AS BIGINT) AS expected, count(*) AS actual FROM l GROUP BY 1, o_custkey HAVING count(*) > 1
UNION ALL SELECT period_id, 'declared_count_mismatch', NULL, CAST(2000 AS BIGINT), count(*) FROM l GROUP BY 1 HAVING count(*) <> 2000""")
def _(t):
    rows = t.orders.select(F.year("o_orderdate").cast("string").alias("period_id"), "o_custkey")
    return G.quality_issues(rows, rows.select("period_id").distinct().withColumn("declared_rows", F.lit(2000)), "o_custkey")


DICT = """WITH v AS (SELECT o_custkey AS type_code, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS base_name, o_orderstatus AS fmt, o_orderkey % 2 = 0 AS av, CAST(o_orderdate AS DATE) AS a,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 400 ELSE CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) END AS b FROM orders), x AS (SELECT *, a <= DATE '1997-06-01' AND (b IS NULL OR b >= DATE '1997-06-01') AS act FROM v)
"""


def dictionary(t):
    d = framed(t.orders, lambda w: {"nxt": F.lead("o_orderdate", 1).over(w)}, 0, 1, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    end = F.when(F.col("o_orderkey") % 5 == 0, F.date_add(F.to_date("o_orderdate"), 400)).otherwise(F.to_date("nxt"))
    return d.select(F.col("o_custkey").alias("type_code"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("base_name"), F.col("o_orderstatus").alias("document_format"),
                    (F.col("o_orderkey") % 2 == 0).alias("available"), F.to_date("o_orderdate").alias("effective_from"), end.alias("effective_to"))


@query("ind26_dictionary", DICT + """SELECT type_code, arg_max(id, {'x': act, 'a': a, 'i': id::BIGINT}) AS canonical_id, bool_or(act) AS is_active, bool_or(av) FILTER (act) AS available, coalesce(bool_or(av) FILTER (act) AND NOT bool_and(av) FILTER (act), false) AS conflict, count(*) AS versions,
 count(DISTINCT base_name) AS names, count(DISTINCT fmt) AS formats, CAST(min(a) AS VARCHAR) AS effective_from, CAST(CASE WHEN count(*) FILTER (b IS NULL) = 0 THEN max(b) END AS VARCHAR) AS effective_to FROM x GROUP BY 1""")
def _(t):
    out = G.resolve_dictionary(dictionary(t), "1997-06-01").drop("canonical_name")
    return out.withColumns({c: F.col(c).cast("string") for c in ("effective_from", "effective_to")})


@query("ind26_aliases", "SELECT DISTINCT o_custkey AS type_code, o_orderpriority AS alias FROM orders")
def _(t):
    return G.dictionary_aliases(dictionary(t))


# --- applicability --------------------------------------------------------------------------------

RULES = """ru AS (SELECT CAST(n * 1000 + len * 100 + p_size AS INT) AS rule_id, p_brand AS type_id, CASE (n + len + p_size) % 5 WHEN 0 THEN 'not_required' WHEN 1 THEN 'unknown' ELSE 'required' END AS rs, CASE (n + p_size) % 3 WHEN 0 THEN '' ELSE p_type END AS st, CASE p_size % 4 WHEN 0 THEN p_brand ELSE '' END AS sk,
 CASE p_size % 5 WHEN 0 THEN 'custom' WHEN 1 THEN 'listed' WHEN 2 THEN 'listed' WHEN 3 THEN 'empty' ELSE 'none' END AS code, p_size % 5 = 2 AS ex, (n + p_size) % 2 = 0 AS ground2 FROM (SELECT DISTINCT p_brand, p_type, p_size, TRY_CAST(substr(p_brand, 7) AS INT) AS n, length(p_type) AS len FROM part WHERE p_size <= 9 AND p_type <> 'SMALL' AND p_type <> 'MEDIUM')),
 su AS (SELECT DISTINCT l_suppkey AS organization_oid, lower(p_type) AS t, lower(p_brand) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 49),
 li AS (SELECT DISTINCT CAST(TRY_CAST(substr(p_brand, 7) AS INT) * 1000 + length(p_type) * 100 + p_size AS INT) AS rule_id, l_suppkey AS organization_oid FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 9 AND p_size % 5 IN (1, 2) AND p_type NOT IN ('SMALL', 'MEDIUM')),
 pn AS (SELECT l_suppkey AS organization_oid, p_type AS sheet_code, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE count(*) END AS annual FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 10 <> 0 AND p_type <> 'LARGE' GROUP BY 1, 2),
 prl AS (SELECT DISTINCT p_brand AS type_id, p_type AS sheet_code, length(p_brand) = 8 AS z FROM part WHERE p_partkey % 50 = 0),
 pv AS (SELECT organization_oid, type_id, CASE WHEN max(annual) > 0 THEN 'required' WHEN bool_or(z) THEN 'not_required' ELSE 'unknown' END AS ps, count(*) AS listed FROM pn JOIN prl USING (sheet_code) GROUP BY 1, 2),
 zz AS (SELECT type_id, bool_or(z) AS z FROM prl GROUP BY 1),
 ve AS (SELECT rule_id, s_suppkey AS organization_oid, ru.type_id, rs, ground2 AND coalesce(ps, 'unknown') = 'unknown' AND coalesce(z, false) AS absent, CASE WHEN ground2 AND ps = 'required' THEN 'matched' WHEN ground2 AND ps = 'not_required' THEN 'not_matched' WHEN ground2 AND coalesce(z, false) THEN 'not_matched'
  WHEN NOT ((st = '' AND sk = '') OR EXISTS (SELECT 1 FROM su WHERE su.organization_oid = s_suppkey AND (st = '' OR t = lower(st)) AND (sk = '' OR k = lower(sk)))) THEN 'not_matched' WHEN code = 'none' THEN 'matched' WHEN code = 'custom' THEN 'unknown' WHEN code = 'empty' THEN 'unknown'
  WHEN rule_id NOT IN (SELECT rule_id FROM li) AND NOT ex THEN 'unknown' WHEN ex THEN CASE WHEN (rule_id, s_suppkey) IN (SELECT (rule_id, organization_oid) FROM li) THEN 'not_matched' ELSE 'matched' END ELSE CASE WHEN (rule_id, s_suppkey) IN (SELECT (rule_id, organization_oid) FROM li) THEN 'matched' ELSE 'not_matched' END END AS verdict
  FROM ru CROSS JOIN supplier LEFT JOIN pv ON pv.organization_oid = s_suppkey AND pv.type_id = ru.type_id LEFT JOIN zz ON zz.type_id = ru.type_id),
 pa2 AS (SELECT *, absent AND organization_oid NOT IN (SELECT organization_oid FROM pn) AS plan_absent FROM ve)"""


def rule_inputs(t):
    s, n, size = F.col("p_size"), brand_no("p_brand"), F.length("p_type")
    number = (n * 1000 + size * 100 + s).cast("int")
    rules = t.part.filter("p_size <= 9 AND p_type NOT IN ('SMALL', 'MEDIUM')").select("p_brand", "p_type", "p_size").distinct().select(
        number.alias("rule_id"), F.col("p_brand").alias("type_id"), F.when((n + size + s) % 5 == 0, "not_required").when((n + size + s) % 5 == 1, "unknown").otherwise("required").alias("requirement_status"),
        F.when((n + s) % 3 == 0, "").otherwise(F.col("p_type")).alias("subdivision_type"), F.when(s % 4 == 0, F.col("p_brand")).otherwise("").alias("subdivision_kind"),
        F.when(s % 5 == 0, "custom").when(s % 5 == 3, "empty").when(s % 5 == 4, "none").otherwise("listed").alias("condition_code"), (s % 5 == 2).alias("excludes"), (s % 5).isin(1, 2).alias("has_list"), F.lit(False).alias("from_directory"),
        F.when((n + s) % 2 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(1))).alias("grounds"))
    lines = t.lineitem.join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey"))
    subs = lines.filter("l_quantity > 49").select(F.col("l_suppkey").alias("organization_oid"), F.col("p_type").alias("subdivision_type"), F.col("p_brand").alias("subdivision_kind"), F.lit("x").alias("name"))
    lists = lines.filter("p_size <= 9 AND p_size % 5 IN (1, 2) AND p_type NOT IN ('SMALL', 'MEDIUM')").select(number.alias("rule_id"), F.col("l_suppkey").alias("organization_oid")).distinct()
    plan = lines.filter("l_suppkey % 10 <> 0 AND p_type <> 'LARGE'").groupBy(F.col("l_suppkey").alias("organization_oid"), F.col("p_type").alias("sheet_code")).agg(F.count(F.lit(1)).alias("c")).select(
        "organization_oid", "sheet_code", F.when(F.col("organization_oid") % 3 == 0, 0).otherwise(F.col("c")).alias("annual_value"))
    plan_rules = t.part.filter("p_partkey % 50 = 0").select(F.col("p_brand").alias("type_id"), F.col("p_type").alias("sheet_code"), (F.length("p_brand") == 8).alias("zero_means_not_required")).distinct()
    return rules, t.supplier.select(F.col("s_suppkey").alias("organization_oid")), subs, lists, plan, plan_rules


@query("ind27_rule_verdicts", "WITH " + RULES + " SELECT rule_id, organization_oid, type_id, rs AS requirement_status, verdict, plan_absent FROM pa2")
def _(t):
    return A.rule_verdicts(*rule_inputs(t))


@query("ind27_applicability", "WITH " + RULES + """, g AS (SELECT organization_oid, type_id, count(*) FILTER (verdict = 'matched' AND rs = 'required') AS r, count(*) FILTER (verdict = 'unknown' OR (verdict = 'matched' AND rs = 'unknown')) AS u, count(*) FILTER (verdict = 'matched') AS m, count(*) FILTER (verdict = 'matched' AND rs = 'not_required') AS n,
 count(*) FILTER (verdict = 'unknown') AS o, bool_or(plan_absent) AS ab FROM pa2 GROUP BY 1, 2), j AS (SELECT s_suppkey AS organization_oid, b.type_id, r, u, m, n, o, ab, CASE WHEN r IS NULL THEN 'unknown' WHEN r > 0 THEN 'required' WHEN u > 0 THEN 'unknown' ELSE 'not_required' END AS st FROM supplier CROSS JOIN (SELECT DISTINCT p_brand AS type_id FROM part) b LEFT JOIN g ON g.organization_oid = s_suppkey AND g.type_id = b.type_id)
 SELECT organization_oid, type_id, st AS requirement_status, r IS NULL AS missing_rule, coalesce(m = 0 AND o = 0, false) AS closed_world, coalesce(ab AND st = 'not_required', false) AS waived, CASE WHEN r IS NULL THEN 0 WHEN r > 0 THEN r WHEN u > 0 THEN m ELSE n END AS evidence_rules FROM j""")
def _(t):
    rules, orgs, subs, lists, plan, plan_rules = rule_inputs(t)
    return A.applicability(t.part.select(F.col("p_brand").alias("type_id")), orgs, rules, A.rule_hits(rules, orgs, subs, lists, plan, plan_rules), plan, plan_rules)


@query("ind27_rule_hits", "WITH " + RULES + " SELECT rule_id, organization_oid, type_id, rs AS requirement_status, verdict FROM pa2 WHERE verdict <> 'not_matched'")
def _(t):
    return A.rule_hits(*rule_inputs(t))


@query("ind27_applicability_cells", "WITH " + RULES + """, g AS (SELECT organization_oid, type_id, count(*) FILTER (verdict = 'matched' AND rs = 'required') AS r, count(*) FILTER (verdict = 'unknown' OR (verdict = 'matched' AND rs = 'unknown')) AS u, count(*) FILTER (verdict = 'matched') AS m,
 count(*) FILTER (verdict = 'matched' AND rs = 'not_required') AS n FROM pa2 WHERE verdict <> 'not_matched' GROUP BY 1, 2) SELECT organization_oid, type_id, CASE WHEN r > 0 THEN 'required' WHEN u > 0 THEN 'unknown' ELSE 'not_required' END AS requirement_status, CASE WHEN r > 0 THEN r WHEN u > 0 THEN m ELSE n END AS evidence_rules FROM g""")
def _(t):
    return A.applicability_cells(A.rule_hits(*rule_inputs(t)))


@query("ind27_type_defaults", "WITH " + RULES + """ SELECT b.type_id, CASE WHEN count(rule_id) > 0 THEN 'not_required' ELSE 'unknown' END AS requirement_status, count(rule_id) = 0 AS missing_rule, count(rule_id) > 0 AS closed_world, coalesce(bool_or(ground2 AND coalesce(z, false)), false) AS waivable
 FROM (SELECT DISTINCT p_brand AS type_id FROM part) b LEFT JOIN ru ON ru.type_id = b.type_id LEFT JOIN zz ON zz.type_id = b.type_id GROUP BY 1""")
def _(t):
    rules, _, _, _, _, plan_rules = rule_inputs(t)
    return A.type_defaults(t.part.select(F.col("p_brand").alias("type_id")), rules, plan_rules)


@query("ind28_plan_rule", "WITH " + RULES + " SELECT organization_oid, type_id, ps AS plan_status, listed FROM pv")
def _(t):
    _, orgs, _, _, plan, plan_rules = rule_inputs(t)
    return A.plan_rule(orgs, plan, plan_rules)


@query("ind29_drop_subsumed", "WITH " + RULES + " SELECT rule_id FROM ru r WHERE NOT (st = 'ECONOMY' AND NOT (sk = '' AND code = 'none') AND EXISTS (SELECT 1 FROM ru w WHERE w.type_id = r.type_id AND w.st = 'ECONOMY' AND w.sk = '' AND w.code = 'none' AND w.rs = 'required'))")
def _(t):
    return A.drop_subsumed(rule_inputs(t)[0], "ECONOMY").select("rule_id")


@query("ind30_directory_override", """WITH d AS (SELECT 'attached' AS condition_code, s_suppkey AS o FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'licensed', s_suppkey FROM supplier WHERE s_nationkey % 2 = 0), c AS (SELECT 'attached' AS condition_code, s_suppkey AS o FROM supplier WHERE s_acctbal > 500 OR s_suppkey % 9 = 0 UNION ALL SELECT 'other', s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
SELECT condition_code, o AS organization_oid, 'added' AS change FROM (FROM d EXCEPT FROM c) UNION ALL SELECT condition_code, o, 'removed' FROM (SELECT * FROM c WHERE condition_code IN (SELECT condition_code FROM d) EXCEPT FROM d)""")
def _(t):
    directory = t.supplier.select(F.col("s_suppkey").alias("organization_oid"), F.create_map(F.lit("pop"), F.col("s_acctbal") > 0, F.lit("1080.1"), F.col("s_nationkey") % 2 == 0).alias("attributes"))
    lists = A.directory_list(directory, {"attached": "pop", "licensed": A.license_code("license_1080_1"), "unknown": "none"})
    comments = t.supplier.filter("s_acctbal > 500 OR s_suppkey % 9 = 0").select(F.lit("attached").alias("condition_code"), F.col("s_suppkey").alias("organization_oid")).unionByName(
        t.supplier.filter("s_suppkey % 2 = 0").select(F.lit("other").alias("condition_code"), F.col("s_suppkey").alias("organization_oid")))
    return A.directory_override(comments, lists)[1]


# --- targets ----------------------------------------------------------------------------------

@query("ind31_apply_targets", """WITH v AS (SELECT CAST(s_suppkey AS VARCHAR) AS indicator_id, s_acctbal AS numerator, 5000.0::DOUBLE AS denominator, round(s_acctbal / 100, 2) AS fv, CASE WHEN s_suppkey % 2 = 0 THEN 'ratio_percent' ELSE 'other' END AS ct, CASE WHEN s_suppkey % 3 = 0 THEN 60.0 ELSE 20.0 END::DOUBLE AS target_value FROM supplier),
 w AS (SELECT indicator_id, target_value, CASE WHEN ct = 'ratio_percent' THEN round(numerator / denominator * 10000) / 100 ELSE fv END AS fact_value FROM v), d AS (SELECT *, round(fact_value - target_value, 2) AS deviation_value FROM w)
SELECT indicator_id, target_value, fact_value, deviation_value, CASE WHEN deviation_value >= 0 THEN 'target_met' WHEN deviation_value <= -10 THEN 'critical' ELSE 'below_target' END AS business_status FROM d""")
def _(t):
    v = t.supplier.select(F.col("s_suppkey").cast("string").alias("indicator_id"), F.lit("p").alias("period_id"), F.col("s_acctbal").alias("numerator"), F.lit(5000.0).alias("denominator"), rnd(F.col("s_acctbal") / 100, 2).alias("fact_value"),
                          F.when(F.col("s_suppkey") % 2 == 0, "ratio_percent").otherwise("other").alias("calculation_type"), F.lit(20.0).alias("target_value"), F.lit("approved").alias("methodology_status"), F.lit("calculated").alias("status"))
    new = v.filter(F.col("indicator_id").cast("int") % 3 == 0).select("indicator_id", "period_id", F.lit(60.0).alias("target_value"))
    return I.apply_targets(v, new).select("indicator_id", "target_value", "fact_value", "deviation_value", "business_status")


@query("ind32_plan_fact_rows", """SELECT s_suppkey AS item_number, s_name AS name, CAST(s_suppkey AS VARCHAR) AS indicator_code, CASE WHEN s_nationkey % 2 = 0 THEN 'percent' ELSE 'unit' END AS unit, 8 AS fact_month, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS fact_value, CASE WHEN s_suppkey % 4 = 1 THEN s_acctbal * 2 END AS year_end_value,
 concat_ws(' ', 'Reporting date: 2026-08-15.', CASE WHEN s_suppkey % 4 = 0 THEN 'Value not calculated.' END, CASE WHEN s_suppkey % 4 = 2 THEN 'checked' END, CASE WHEN s_suppkey % 4 <> 1 THEN 'No year-end target is set.' END) AS notes FROM supplier""")
def _(t):
    s = t.supplier
    ind = s.select(F.col("s_suppkey").cast("string").alias("indicator_id"), F.col("s_suppkey").alias("item_number"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("indicator_code"), F.when(F.col("s_nationkey") % 2 == 0, "%").otherwise("types").alias("unit"))
    val = s.filter("s_suppkey % 4 <> 0").select(F.col("s_suppkey").cast("string").alias("indicator_id"), F.col("s_acctbal").alias("fact_value"), F.when(F.col("s_suppkey") % 4 == 1, F.col("s_acctbal") * 2).alias("target_year_end_value"),
                                                F.lit("calculated").alias("status"), F.when(F.col("s_suppkey") % 4 == 2, " checked ").otherwise("").alias("note"))
    return I.plan_fact_rows(ind, val, "2026-08-15")


# --- outlook ----------------------------------------------------------------------------------

FORECAST = """, fc0 AS (SELECT period_id, indicator_id, sum(coalesce(plan, 0)) AS year_plan, sum(fact) AS fact_to_date, count(fact) AS months_with_fact, max(month) FILTER (fact IS NOT NULL) AS last, arg_min(month, {'a': -fact, 'b': month}) FILTER (fact IS NOT NULL) AS best_month, max(fact) AS best_month_fact FROM pt GROUP BY 1, 2 HAVING sum(coalesce(plan, 0)) > 0 AND count(fact) > 0),
 fc AS (SELECT *, greatest(0, 12 - last) AS months_left, fact_to_date + best_month_fact * greatest(0, 12 - last) AS ceiling FROM fc0),
 fo AS (SELECT *, CASE WHEN months_left > 0 THEN greatest(0, ceil((year_plan - fact_to_date) / months_left)) ELSE 0 END::BIGINT AS required_per_month, ceiling >= year_plan AS achievable FROM fc)
"""


@query("ind33_forecast", BASE + FORECAST + "SELECT period_id, indicator_id, year_plan, fact_to_date, round(fact_to_date / year_plan * 100, 1) AS fact_share, months_with_fact, months_left, best_month, best_month_fact, required_per_month, ceiling, round(ceiling / year_plan * 100, 1) AS ceiling_share, achievable FROM fo")
def _(t):
    return M.forecast(points(t))


ANOMALY = """, sq AS (SELECT *, lag(month) OVER w AS pm_, lag(fact) OVER w AS pf, max(month) OVER (PARTITION BY period_id, indicator_id) AS last, count(*) OVER (PARTITION BY period_id, indicator_id) AS n FROM pt WHERE fact IS NOT NULL WINDOW w AS (PARTITION BY period_id, indicator_id ORDER BY month)),
 sd AS (SELECT period_id, indicator_id, arg_min(pm_, {'a': -pf / fact, 'b': month}) AS month, arg_min(month, {'a': -pf / fact, 'b': month}) AS other_month, arg_min(round((1 - fact / pf) * 100, 1), {'a': -pf / fact, 'b': month}) AS value FROM sq WHERE n >= 3 AND month = pm_ + 1 AND fact > 0 AND month <> last AND pf / fact >= 1.4 GROUP BY 1, 2),
 jt AS (SELECT period_id, indicator_id, max(fact) FILTER (month = 1) AS jan, avg(fact) FILTER (month > 1) AS av, count(fact) FILTER (month > 1) AS n FROM pt GROUP BY 1, 2),
 an AS (SELECT period_id, indicator_id, 'spike_and_drop' AS code, month, other_month, value FROM sd UNION ALL SELECT period_id, indicator_id, 'january_tail', 1, NULL, jan FROM jt WHERE jan > 0 AND n >= 2 AND jan >= av * 1.25
  UNION ALL SELECT period_id, indicator_id, 'flat_plan', NULL, NULL, round((max(plan) - min(plan)) / avg(plan) * 100, 1) FROM pt GROUP BY 1, 2 HAVING count(plan) >= 12 AND avg(plan) > 0 AND (max(plan) - min(plan)) / avg(plan) < 0.01
  UNION ALL SELECT period_id, indicator_id, 'ratio_over_plan', arg_min(top_month, {'a': -top, 'b': top_month}), NULL, round(max(top), 1) FROM bd WHERE top > 100 GROUP BY 1, 2 UNION ALL SELECT period_id, indicator_id, 'missing_execution', NULL, NULL, NULL FROM bd GROUP BY 1, 2 HAVING count(*) FILTER (case_fact IS NULL) > 0)
"""


@query("ind34_anomalies", BASE + ANOMALY + "SELECT * FROM an")
def _(t):
    return M.anomalies(points(t), breakdown(t)).drop("base", "n")


@query("ind34_evenness", BASE + """SELECT period_id, indicator_id, count(ratio) AS n, min(ratio) AS low, max(ratio) AS high, arg_min(month, {'a': ratio, 'b': month}) FILTER (ratio IS NOT NULL) AS low_month, arg_min(month, {'a': -ratio, 'b': month}) FILTER (ratio IS NOT NULL) AS high_month,
 CASE WHEN min(ratio) > 0 THEN max(ratio) / min(ratio) >= 1.5 ELSE true END AS uneven FROM pt GROUP BY 1, 2 HAVING count(ratio) >= 2""")
def _(t):
    return M.evenness(points(t))


@query("ind35_verdict", BASE + FORECAST + ANOMALY + """, fl AS (SELECT period_id, indicator_id, bool_or(code = 'spike_and_drop') AS sp, bool_or(code = 'missing_execution') AS mi FROM an GROUP BY 1, 2)
 SELECT coalesce(fo.period_id, fl.period_id) AS period_id, coalesce(fo.indicator_id, fl.indicator_id) AS indicator_id, CASE WHEN NOT achievable THEN 'unreachable' WHEN sp THEN 'uneven' WHEN achievable AND months_left > 0 AND required_per_month > fact_to_date / months_with_fact THEN 'tight' WHEN mi THEN 'no_execution_data' WHEN achievable THEN 'on_track' END AS verdict
 FROM fo FULL JOIN fl ON fo.period_id = fl.period_id AND fo.indicator_id = fl.indicator_id""")
def _(t):
    p = points(t)
    return M.verdict(M.forecast(p), M.anomalies(p, breakdown(t)))


GAP = BASE + """, gp AS (SELECT vv.*, s_name AS organization_name, CASE WHEN denominator IS NOT NULL THEN greatest(0, denominator - numerator) END AS gap FROM vv JOIN supplier ON s_suppkey = organization_oid),
 gr AS (SELECT *, row_number() OVER w AS place, sum(coalesce(gap, 0)) OVER (PARTITION BY period_id, indicator_id) AS tot, sum(coalesce(gap, 0)) OVER (PARTITION BY period_id, indicator_id ORDER BY gap IS NULL, gap DESC, organization_name ROWS UNBOUNDED PRECEDING) AS cum FROM gp WINDOW w AS (PARTITION BY period_id, indicator_id ORDER BY gap IS NULL, gap DESC, organization_name))
"""


def named_values(t):
    return values(t).join(t.supplier.select(F.col("s_suppkey").alias("organization_oid"), F.col("s_name").alias("organization_name")), "organization_oid")


@query("ind36_gap_rows", GAP + "SELECT period_id, indicator_id, organization_oid, gap, CASE WHEN gap IS NOT NULL AND tot > 0 THEN round(gap / tot * 100, 2) END AS share_of_gap, place FROM gr")
def _(t):
    return M.gap_rows(named_values(t)).select("period_id", "indicator_id", "organization_oid", "gap", "share_of_gap", "place")


@query("ind36_gap_summary", GAP + """SELECT period_id, indicator_id, max(tot) AS total_gap, coalesce(sum(numerator) FILTER (status = 'calculated'), 0) AS total_fact, coalesce(sum(denominator), 0) AS total_plan, count(*) FILTER (status = 'calculated') AS calculated, count(*) FILTER (status = 'no_approved_volume') AS no_approved_volume,
 coalesce(sum(numerator) FILTER (status = 'no_approved_volume'), 0) AS fact_without_plan, count(*) FILTER (status = 'not_participating') AS not_participating, coalesce(min(place) FILTER (gap > 0 AND cum >= tot * 80 / 100), count(*) FILTER (gap > 0)) AS organizations_to_close FROM gr GROUP BY 1, 2""")
def _(t):
    return M.gap_summary(named_values(t))


@query("ind37_flags", PILOT + "SELECT period_id, count(*) FILTER (coalesce(act < req, false) OR missing_at_organization > 0 OR blocked > 0 OR unknown_capability > 0 OR unexpected > 0) AS has_problem FROM (SELECT oc.*, (SELECT count(*) FROM ps WHERE ps.period_id = oc.period_id AND ps.organization_oid = oc.organization_oid AND pair_status = 'required_unknown') AS unknown_capability FROM oc) GROUP BY 1")
def _(t):
    o = pilot_orgs(t).withColumns({"fact_value": F.col("actual_types"), "target_value": F.col("planned_types")})
    return V.flag_counts(o).select("period_id", "has_problem")


@query("ind38_percent_bands", BASE + "SELECT CASE WHEN percent >= 100 THEN 0 WHEN percent >= 86.9 THEN 1 WHEN percent >= 60 THEN 2 WHEN percent >= 34 THEN 3 WHEN percent IS NOT NULL THEN 4 END AS band, count(*) AS n FROM vv GROUP BY 1")
def _(t):
    return values(t).groupBy(M.percent_band(F.col("percent")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


# --- snapshots --------------------------------------------------------------------------------

@query("ind39_transitions", f"""WITH s AS (SELECT l_suppkey AS o, p_brand AS t, count(*) FILTER (year(l_shipdate) = 1996) AS b, count(*) FILTER (year(l_shipdate) = 1997) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), c AS (SELECT CASE WHEN b > 0 THEN CASE WHEN b > 4 THEN 'required' ELSE 'unknown' END END AS was, CASE WHEN a > 0 THEN CASE WHEN a > 4 THEN 'required' ELSE 'unknown' END END AS now FROM s)
SELECT was, now, count(*) AS n FROM c WHERE was IS DISTINCT FROM now GROUP BY 1, 2""")
def _(t):
    return G.transitions(G.changed_pairs(_snapshot(t, "1996"), _snapshot(t, "1997")))


def _snapshot(t, period):
    m = months(t).filter(F.col("period_id") == period).groupBy("organization_oid", F.col("type_code").alias("type_id")).agg(F.sum("document_count").alias("n"))
    return m.withColumn("requirement_status", F.when(F.col("n") > 4, "required").otherwise("unknown"))


@query("ind39_changed_values", BASE + """SELECT coalesce(b.indicator_id, a.indicator_id) AS indicator_id, coalesce(b.organization_oid, a.organization_oid) AS organization_oid, b.numerator AS numerator_was, a.numerator AS numerator_now, b.denominator AS denominator_was, a.denominator AS denominator_now, b.percent AS fact_value_was, a.percent AS fact_value_now
 FROM (SELECT * FROM vv WHERE period_id = '1996' AND organization_oid % 8 <> 0) b FULL JOIN (SELECT * FROM vv WHERE period_id = '1997') a ON a.indicator_id = b.indicator_id AND a.organization_oid = b.organization_oid WHERE (b.numerator, b.denominator, b.percent) IS DISTINCT FROM (a.numerator, a.denominator, a.percent)""")
def _(t):
    v = values(t).withColumnRenamed("percent", "fact_value")
    return G.changed_values(v.filter("period_id = '1996' AND organization_oid % 8 <> 0"), v.filter("period_id = '1997'"))


@query("ind39_renamed", "SELECT s_suppkey AS organization_oid, s_name AS was, s_name || ' new' AS now FROM supplier WHERE s_suppkey % 7 = 0")
def _(t):
    b = t.supplier.select(F.col("s_suppkey").alias("organization_oid"), F.col("s_name").alias("organization_name"))
    a = b.withColumn("organization_name", F.when(F.col("organization_oid") % 7 == 0, F.concat("organization_name", F.lit(" new"))).otherwise(F.col("organization_name")))
    return G.renamed(b, a)


@query("ind39_finding_delta", PILOT + PAIR_FINDINGS + "SELECT finding_code, count(*) FILTER (period_id = '1996') AS was, count(*) FILTER (period_id = '1997') AS now, count(*) FILTER (period_id = '1997') - count(*) FILTER (period_id = '1996') AS delta FROM ff WHERE period_id IN ('1996', '1997') GROUP BY 1")
def _(t):
    f = pilot_findings(t)
    return G.finding_delta(f.filter("period_id = '1996'"), f.filter("period_id = '1997'"))


@query("ind40_requirement_breakdown", """SELECT l_suppkey AS organization_oid, CASE WHEN p_size % 4 = 0 THEN 'unconditional' ELSE p_type END AS condition, count(*) AS types, count(*) FILTER (l_quantity > 25) AS registered FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def _(t):
    lines = t.lineitem.join(keyed(t.part), F.col("l_partkey") == F.col("p_partkey"))
    reason = F.when(F.col("p_size") % 4 == 0, "Required by the matrix (row 7).").otherwise(F.concat(F.lit("Required (row 28: "), "p_type", F.lit("; row 29: other)")))
    req = lines.select(F.col("l_suppkey").alias("organization_oid"), F.col("p_brand").alias("type_id"), F.when(F.col("l_returnflag") == "R", "required").otherwise("unknown").alias("status"), reason.alias("reason"), (F.col("l_quantity") > 25).alias("registered"))
    return G.requirement_breakdown(req)

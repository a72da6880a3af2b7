"""Filters, projections, joins, aggregation, charts, ranking and scalar functions on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import parse, text
from ..functions.columns import percent, rnd
from ..operators import aggregate as A
from ..operators import charts as C
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import projection as R
from ..operators import ranking as K
from ..operators.ordered import row_numbers
from ..session import shared_folder
from ..sources import readers, sinks
from .base import query

EMPTY = "(пусто)"


# --- flagship ---------------------------------------------------------------------------------

@query("revenue_by_nation", """
SELECT n_name, count(*) AS _count, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 100000 AND o_orderstatus IN ('O', 'F') GROUP BY n_name""")
def _(t):
    rich = P.apply_filters(t.orders, {"o_totalprice": {"type": "number", "operator": ">", "value": 100000},
                                      "o_orderstatus": {"type": "string", "operator": "categoryEquals", "value": "O"},
                                      "o_orderstatus__dup__1": {"type": "string", "operator": "categoryEquals", "value": "F"}})
    star = J.star_join({"c": t.customer.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")),
                        "o": rich.select(F.col("o_custkey").alias("custkey"), "o_totalprice"),
                        "n": t.nation.select(F.col("n_nationkey").alias("nationkey"), "n_name")}, ["custkey", "nationkey"], sep="__")
    out = A.group_aggregate(star, ["n__n_name"], [("o__o_totalprice", "SUM")])
    out = out.select(F.col("n__n_name").alias("n_name"), "_count", rnd("SUM(o__o_totalprice)", 2).alias("revenue"))
    return K.page(out, "revenue", "desc", 1000, tie_break=["n_name"])


# --- sources ----------------------------------------------------------------------------------

def _roundtrip(t, df, fmt):
    return f"{shared_folder(t.spark)}/planlens-{uuid.uuid4().hex}/{fmt}"


@query("src1_csv_inferred", "SELECT * FROM orders")
def _(t):
    path = _roundtrip(t, t.orders, "csv")
    sinks.write(t.orders, path, "csv")
    return readers.read_csv(t.spark, path)


@query("src1_csv_line_breaks", "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents")
def _(t):
    path = _roundtrip(t, t.documents, "csv")
    sinks.write(t.documents, path, "csv")
    return readers.read_csv(t.spark, path)


@query("src2_detected_types", """
SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders""")
def _(t):
    path = _roundtrip(t, t.orders, "csv")
    sinks.write(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")), path, "csv")
    raw = readers.read_text_csv(t.spark, path)
    out = readers.cast_types(raw, readers.detect_types(raw))
    return out.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


@query("src3_routed_read", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return readers.read_table(t.spark, f"{t.directory}/nation.parquet")


@query("src4_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def _(t):
    return readers.scan_parquet(t.spark, f"{t.directory}/lineitem.parquet").filter("l_quantity >= 49").select("l_orderkey", "l_quantity")


@query("src5_catalog_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def _(t):
    t.customer.createOrReplaceTempView("customer_source")
    return t.spark.table("customer_source").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("snk1_csv_sink", "SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part")
def _(t):
    path = _roundtrip(t, t.part, "csv")
    sinks.write(t.part, path, "csv")
    return readers.read_csv(t.spark, path)


@query("snk2_parquet_sink", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    path = _roundtrip(t, t.orders, "parquet")
    sinks.write(t.orders, path)
    return readers.scan_parquet(t.spark, path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("snk3_write_formats", "SELECT 'csv' AS fmt, count(*) AS n, round(sum(p_retailprice), 2) AS s FROM part UNION ALL SELECT 'parquet', count(*), round(sum(p_retailprice), 2) FROM part")
def _(t):
    paths = sinks.write_formats(t.part, _roundtrip(t, t.part, "all"), ["Parquet", "csv", "parquet"])
    parts = [readers.read_csv(t.spark, p) if f == "csv" else t.spark.read.parquet(p) for f, p in sorted(paths.items())]
    return parts[0].agg(F.lit("csv").alias("fmt"), F.count(F.lit(1)).alias("n"), rnd(F.sum("p_retailprice"), 2).alias("s")).unionByName(
        parts[1].agg(F.lit("parquet").alias("fmt"), F.count(F.lit(1)).alias("n"), rnd(F.sum("p_retailprice"), 2).alias("s")))


@query("snk4_staged_table", "SELECT count(*) AS n, count(DISTINCT s_nationkey) AS k FROM supplier")
def _(t):
    return sinks.stage(t.supplier, _roundtrip(t, t.supplier, "stage")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s_nationkey").alias("k"))


@query("snk5_export_csv", "SELECT count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS chars FROM customer")
def _(t):
    path = _roundtrip(t, t.customer, "export")
    sinks.export_csv(t.customer, path)
    back = t.spark.read.csv(path, header=True)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("c_name")).alias("chars"))


@query("snk6_visible_columns", "SELECT c_name AS \"Name\", coalesce(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END, '') AS \"Segment\" FROM customer")
def _(t):
    d = t.customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return R.export_columns(d, {"c_name": "Name", "c_mktsegment": "Segment"})


FACTS = "SELECT year(l_shipdate) AS period_id, l_suppkey AS org, l_returnflag AS typ, count(*) AS n FROM lineitem GROUP BY ALL"


def _facts(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("period_id"), F.col("l_suppkey").alias("org"),
                              F.col("l_returnflag").alias("typ")).agg(F.count(F.lit(1)).alias("n"))


@query("snk7_merge_facts", f"""
WITH f AS ({FACTS}) SELECT period_id, org, typ, CASE WHEN period_id = 1995 AND typ = 'R' THEN n + 1000 ELSE n END AS n FROM f""")
def _(t):
    f = _facts(t)
    path = _roundtrip(t, f, "facts")
    sinks.load_facts(f, path, ["period_id", "org", "typ"], "replace")
    news = f.filter("period_id = 1995 AND typ = 'R'").withColumn("n", F.col("n") + 1000)
    sinks.load_facts(news, path, ["period_id", "org", "typ"], "merge")
    return t.spark.read.parquet(path)


@query("snk7_replace_facts", f"""
WITH f AS ({FACTS}) SELECT period_id, org, typ, n FROM f WHERE NOT (period_id = 1995 AND typ <> 'R')""")
def _(t):
    f = _facts(t)
    path = _roundtrip(t, f, "facts")
    sinks.load_facts(f, path, ["period_id", "org", "typ"], "replace")
    sinks.load_facts(f.filter("period_id = 1995 AND typ = 'R'"), path, ["period_id", "org", "typ"], "replace")
    return t.spark.read.parquet(path)


@query("snk8_upsert_values", f"""
WITH f AS ({FACTS}) SELECT period_id, typ AS indicator_id, org, n FROM f
WHERE NOT (period_id = 1995 AND n <= 2 AND typ IN (SELECT typ FROM f WHERE period_id = 1995 AND n > 2))""")
def _(t):
    f = _facts(t).withColumnRenamed("typ", "indicator_id")
    path = _roundtrip(t, f, "values")
    sinks.upsert_values(f, path)
    sinks.upsert_values(f.filter("period_id = 1995 AND n > 2"), path)
    return t.spark.read.parquet(path)


@query("snk8_upsert_rows", f"""
WITH f AS ({FACTS}) SELECT period_id, org, typ, n FROM f WHERE NOT (period_id = 1995 AND n <= 2)""")
def _(t):
    f = _facts(t)
    return sinks.upsert_rows(f, f.filter("period_id = 1995 AND n > 2"), ["period_id"])


@query("snk9_snapshot", f"WITH f AS ({FACTS}) SELECT period_id, org, typ, n FROM f WHERE period_id < 1996")
def _(t):
    f = _facts(t)
    path = _roundtrip(t, f, "snap")
    sinks.save_snapshot(f.filter("period_id < 1996"), path, "a")
    sinks.save_snapshot(f, path, "b")
    return sinks.read_snapshot(t.spark, path, "a").drop("import_id")


# --- projections ------------------------------------------------------------------------------

@query("prj1_projection", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return R.project(t.orders, ["o_totalprice", "missing"], row_id="o_orderkey")


def _clinical(t, sep="."):
    return J.star_join({"orders": t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), "o_totalprice"),
                        "customer": t.customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment"),
                        "lineitem": t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_quantity")},
                       ["orderkey", "custkey"], sep)


@query("prj2_joined_projection", """
SELECT o_orderkey AS "orders.orderkey", c_mktsegment AS "customer.c_mktsegment", l_quantity AS "lineitem.l_quantity"
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    return R.project_joined(_clinical(t), ["orders.orderkey", "customer.c_mktsegment", "lineitem.l_quantity"])


@query("prj3_calculated_field", """
SELECT l_orderkey, l_linenumber, (l_extendedprice * (1 - l_discount)) / nullif(l_quantity - 10, 0) AS net FROM lineitem""")
def _(t):
    return R.with_calculated(t.lineitem, "net", "(l_extendedprice*(1-l_discount))/(l_quantity-10)").select(
        "l_orderkey", "l_linenumber", "net")


# --- filters ----------------------------------------------------------------------------------

def _spec(kind, op, *v):
    return {"type": kind, "operator": op, **({"valueFrom": v[0], "valueTo": v[1]} if op == "between" else {"value": v[0]} if v else {})}


@query("flt1_number_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount >= 0.05 AND l_tax IS NOT NULL")
def _(t):
    return P.apply_filters(t.lineitem, {"l_quantity": _spec("number", "between", 10, 12), "l_discount": _spec("number", ">=", 0.05),
                                        "l_tax": _spec("number", "isNotNull")}).select("l_orderkey", "l_linenumber")


@query("flt2_date_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' OR CAST(l_shipdate AS DATE) = DATE '1997-05-05'")
def _(t):
    a = P.apply_filters(t.lineitem, {"l_shipdate": _spec("date", "between", "1996-01-01", "1996-03-31")})
    b = P.apply_filters(t.lineitem, {"l_shipdate": _spec("date", "==", "1997-05-05")})
    return a.unionByName(b).select("l_orderkey", "l_linenumber")


@query("flt3_datetime_filter", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-11 06:30:00'")
def _(t):
    return P.apply_filters(t.events, {"ts": _spec("datetime", ">", "2024-01-10 12:00:00"),
                                      "ts__dup__1": _spec("datetime", "<", "2024-01-11 06:30:00")}).select("event_id")


@query("flt4_time_filter", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') BETWEEN '09:00:00' AND '09:30:00'")
def _(t):
    d = t.events.select("event_id", F.date_format("ts", "HH:mm:ss").alias("tod"))
    return P.apply_filters(d, {"tod": _spec("time", "between", "9:00", "09:30")}).select("event_id")


@query("flt5_string_filter", "SELECT p_partkey FROM part WHERE p_name ILIKE '%ar%' AND p_brand <> 'Brand#11'")
def _(t):
    return P.apply_filters(t.part, {"p_name": _spec("string", "ilike", "%AR%"), "p_brand": _spec("string", "categoryNotEquals", "Brand#11")}).select("p_partkey")


@query("flt6_category_or", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def _(t):
    return P.apply_filters(t.customer, {"c_mktsegment": _spec("string", "categoryEquals", "BUILDING"),
                                        "c_mktsegment__dup__2": _spec("string", "categoryEquals", "MACHINERY"),
                                        "c_acctbal": _spec("number", ">", 0)}).select("c_custkey")


@query("flt7_query_filter", "SELECT p_partkey FROM part WHERE p_name ILIKE '%an%' AND p_size <= 20 AND p_type IS NOT NULL AND CAST(p_size AS VARCHAR) <> '3'")
def _(t):
    return P.apply_filters(t.part, {"p_name": {"type": "string", "operator": "like", "value": "AN"}, "p_size": _spec("number", "<=", 20),
                                    "p_type": {"type": "string", "operator": "notnull"},
                                    "p_size__dup__1": {"type": "number", "operator": "neq", "value": "3"}}, contains=True).select("p_partkey")


@query("flt8_multi_value", r"""
SELECT p_partkey, list_contains(list_transform(regexp_split_to_array(p_name, '\s+'), lambda x: lower(trim(x))), 'green') AS has FROM part""")
def _(t):
    return t.part.select("p_partkey", P.has_part("p_name", r"\s+", "Green").alias("has"))


@query("flt8_multi_value_absent", r"""
SELECT p_partkey FROM part WHERE NOT list_contains(list_transform(regexp_split_to_array(p_name, '\s+'), lambda x: lower(trim(x))), 'green')""")
def _(t):
    return P.apply_filters(t.part, {"p_name": _spec("string", "categoryNotEquals", "green")}, multi_value={"p_name": r"\s+"}).select("p_partkey")


@query("flt9_hide_nulls", "SELECT o_orderkey FROM orders WHERE o_custkey % 5 <> 0 AND o_orderkey % 3 <> 0")
def _(t):
    d = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).alias("a"),
                        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).otherwise("").alias("b"))
    return P.hide_nulls(d, ["a", "b"]).select("o_orderkey")


@query("flt10_widget_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 200000")
def _(t):
    return P.widget_filter(t.orders, [{"field": "o_orderpriority", "kind": "select", "values": ["1-URGENT", "2-HIGH"]},
                                      {"field": "o_totalprice", "kind": "range", "min": 200000}]).select("o_orderkey")


@query("flt11_cross_filter", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity = 17 GROUP BY l_returnflag")
def _(t):
    return P.cross_filter(t.lineitem, "l_quantity", 17).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


VERSIONS = """SELECT o_custkey AS type_code, o_orderkey AS id, o_orderstatus, CAST(o_orderdate AS DATE) AS effective_from,
 CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS effective_to FROM orders"""


def versions(t):
    from ..operators.ordered import framed
    d = framed(t.orders, lambda w: {"nxt": F.lead("o_orderdate", 1).over(w)}, 0, 1, ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return d.select(F.col("o_custkey").alias("type_code"), F.col("o_orderkey").alias("id"), "o_orderstatus",
                    F.to_date("o_orderdate").alias("effective_from"), F.to_date("nxt").alias("effective_to"))


@query("flt12_effective_at", f"WITH v AS ({VERSIONS}) SELECT type_code, id FROM v WHERE effective_from <= DATE '1996-06-01' AND (effective_to IS NULL OR effective_to >= DATE '1996-06-01')")
def _(t):
    return P.effective_at(versions(t), "1996-06-01").select("type_code", "id")


# --- joins ------------------------------------------------------------------------------------

@query("jon1_star_join", """
SELECT o_orderkey AS orders__orderkey, c_mktsegment AS customer__c_mktsegment, l_linenumber AS lineitem__l_linenumber
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey""")
def _(t):
    return _clinical(t, "__").select("orders__orderkey", "customer__c_mktsegment", "lineitem__l_linenumber")


@query("jon2_category_lookup", "SELECT l_orderkey, l_linenumber, c FROM lineitem LEFT JOIN (SELECT l_suppkey AS k, count(*) AS c FROM lineitem GROUP BY 1) ON k = l_suppkey")
def _(t):
    return J.lookup(t.lineitem, t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("c")), "l_suppkey").select("l_orderkey", "l_linenumber", "c")


@query("jon3_resolve_overrides", f"""
WITH f AS ({FACTS}), m AS (SELECT period_id, org, typ, n * 2 AS n FROM f WHERE org % 4 = 0 UNION ALL SELECT 2050, org, typ, n FROM f WHERE period_id = 1994)
SELECT period_id, org, typ, coalesce(m.n, f.n) AS n, m.n IS NOT NULL AS is_manual FROM f FULL JOIN m USING (period_id, org, typ)""")
def _(t):
    f = _facts(t)
    m = f.filter("org % 4 = 0").withColumn("n", F.col("n") * 2).unionByName(f.filter("period_id = 1994").withColumn("period_id", F.lit(2050)))
    return J.resolve_overrides(f, m, ["period_id", "org", "typ"], ["n"])


@query("jon4_active_versions", f"""
WITH v AS ({VERSIONS}), a AS (SELECT type_code, count(*) AS n, bool_or(o_orderstatus = 'F') AS f FROM v
 WHERE effective_from <= DATE '1996-06-01' AND (effective_to IS NULL OR effective_to >= DATE '1996-06-01') GROUP BY 1)
SELECT c_custkey AS type_code, coalesce(n, 0) AS active_count, coalesce(f, false) AS any_flag FROM customer LEFT JOIN a ON type_code = c_custkey""")
def _(t):
    v = versions(t).withColumn("closed", F.col("o_orderstatus") == "F")
    return J.active_versions(t.customer.select(F.col("c_custkey").alias("type_code")), v, "1996-06-01", "type_code", "closed")


@query("jon5_first_stay_only", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM (
 SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1)""")
def _(t):
    stays = t.orders.withColumnRenamed("o_orderkey", "l_orderkey")
    return J.first_stay_only(t.lineitem, stays, "o_custkey", "l_orderkey", ["o_orderdate", "l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("jon6_unknown_members", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total, count(*) AS fact_rows FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1")
def _(t):
    known = t.supplier.filter("s_acctbal > 0").withColumnRenamed("s_suppkey", "l_suppkey")
    return J.unknown_members(t.lineitem, known, "l_suppkey", "l_quantity").withColumn("total", rnd("total", 2))


@query("jon7_capability_cascade", """
WITH pairs AS (SELECT DISTINCT l_suppkey AS org, l_partkey AS typ FROM lineitem),
 own AS (SELECT org, typ, typ % 2 = 0 AS available FROM pairs WHERE (org + typ) % 5 = 0),
 dir AS (SELECT p_partkey AS typ, p_size > 25 AS available FROM part WHERE p_partkey % 3 = 0),
 seen AS (SELECT DISTINCT l_partkey AS typ FROM lineitem WHERE l_returnflag = 'R')
SELECT org, typ, coalesce(own.available, dir.available, CASE WHEN seen.typ IS NOT NULL THEN true END) AS available,
 CASE WHEN own.available IS NOT NULL THEN 'own' WHEN dir.available IS NOT NULL THEN 'directory' WHEN seen.typ IS NOT NULL THEN 'seen' END AS source
FROM pairs LEFT JOIN own USING (org, typ) LEFT JOIN dir USING (typ) LEFT JOIN seen USING (typ)""")
def _(t):
    pairs = t.lineitem.select(F.col("l_suppkey").alias("org"), F.col("l_partkey").alias("typ")).distinct()
    own = pairs.filter("(org + typ) % 5 = 0").withColumn("available", F.col("typ") % 2 == 0)
    directory = t.part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("typ"), (F.col("p_size") > 25).alias("available"))
    seen = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("typ"))
    return J.capability_cascade(pairs, own, directory, seen, "typ", ["org", "typ"])


@query("jon8_resolve_names", """
WITH d AS (SELECT n_nationkey AS id, upper(trim(n_name)) AS k FROM nation UNION SELECT n_nationkey, upper(substr(n_name, 1, 1)) FROM nation),
 i AS (SELECT k, min(id) AS lo, max(id) AS hi FROM d GROUP BY k),
 q AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN substr(n_name, 1, 1) WHEN c_custkey % 3 = 1 THEN ' ' || lower(n_name) ELSE n_name || 'X' END AS nm FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, nm, CASE WHEN lo = hi THEN lo END AS resolved_id, CASE WHEN lo IS NULL THEN 'none' WHEN lo = hi THEN 'single' ELSE 'ambiguous' END AS "match"
FROM q LEFT JOIN i ON upper(trim(nm)) = k""")
def _(t):
    directory = t.nation.withColumn("short", F.substring("n_name", 1, 1))
    q = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.substring("n_name", 1, 1))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" "), F.lower("n_name"))).otherwise(F.concat("n_name", F.lit("X"))).alias("nm"))
    return J.resolve_names(q, directory, "nm", "n_nationkey", ["n_name", "short"], lambda c: F.upper(F.trim(c)))


@query("jon9_resolve_groups", """
WITH a AS (SELECT n_nationkey AS id, upper(n_name) AS k, 0 AS g FROM nation UNION ALL SELECT n_nationkey, upper(substr(n_name, 1, 1)), 0 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'REGION ' || n_regionkey, 1 FROM nation UNION ALL SELECT n_nationkey, upper(substr(n_name, 1, 1)), 1 FROM nation WHERE n_nationkey % 2 = 1),
 i AS (SELECT k, count(*) AS n, sum(g) AS ng, min(id) AS id FROM (SELECT k, id, max(g) AS g FROM a GROUP BY k, id) GROUP BY k),
 q AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN substr(n_name, 1, 1) WHEN c_custkey % 4 = 1 THEN n_name WHEN c_custkey % 4 = 2 THEN 'Region ' || n_regionkey ELSE 'nobody' END AS nm
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, nm, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'single' WHEN n = ng THEN 'group' ELSE 'ambiguous' END AS "match",
 coalesce(n, 0) AS member_count, CASE WHEN n = 1 THEN id END AS resolved_id FROM q LEFT JOIN i ON upper(nm) = k""")
def _(t):
    even = F.col("n_nationkey") % 2 == 0
    q = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.substring("n_name", 1, 1))
        .when(F.col("c_custkey") % 4 == 1, F.col("n_name")).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("Region "), "n_regionkey")).otherwise("nobody").alias("nm"))
    first = F.substring("n_name", 1, 1)
    return J.resolve_groups(q, t.nation, "nm", "n_nationkey", F.array_compact(F.array("n_name", F.when(even, first))),
                            F.array_compact(F.array(F.concat(F.lit("Region "), "n_regionkey"), F.when(~even, first))), lambda c: F.array(F.upper(c)))


@query("jon10_distinct_parts", r"SELECT DISTINCT trim(w) AS part FROM (SELECT unnest(regexp_split_to_array(p_name, '\s+')) AS w FROM part) WHERE trim(w) <> ''")
def _(t):
    return J.distinct_parts(t.part, "p_name", r"\s+")


@query("jon11_grid", "SELECT s_suppkey, b AS p_brand FROM supplier, (SELECT DISTINCT p_brand AS b FROM part)")
def _(t):
    return J.grid(t.supplier.select("s_suppkey"), t.part, "p_brand")


@query("jon12_institution_details", """
WITH f AS (SELECT l_suppkey AS org, p_brand AS typ, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1, 2),
 g AS (SELECT s_suppkey AS org, b AS typ FROM supplier, (SELECT DISTINCT p_brand AS b FROM part)),
 r AS (SELECT org, typ, CASE WHEN org % 2 = 0 THEN 'required' ELSE 'not_required' END AS status FROM g WHERE org % 3 <> 0),
 o AS (SELECT org, typ, 'required' AS status FROM g WHERE org % 7 = 0), c AS (SELECT org, typ, org % 5 = 0 AS available FROM g WHERE org % 2 = 1)
SELECT org, typ, coalesce(f.n, 0) AS document_count, coalesce(o.status, r.status, 'unknown') AS requirement_status, o.status IS NOT NULL AS is_manual, c.available
FROM g LEFT JOIN f USING (org, typ) LEFT JOIN r USING (org, typ) LEFT JOIN o USING (org, typ) LEFT JOIN c USING (org, typ)""")
def _(t):
    facts = t.lineitem.join(t.part.filter("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_suppkey").alias("org"), F.col("p_brand").alias("typ")).agg(F.count(F.lit(1)).alias("n"))
    orgs, types = t.supplier.select(F.col("s_suppkey").alias("org")), t.part.select(F.col("p_brand").alias("typ"))
    g = J.grid(orgs, types, "typ")
    req = g.filter("org % 3 <> 0").withColumn("status", F.when(F.col("org") % 2 == 0, "required").otherwise("not_required"))
    ovr = g.filter("org % 7 = 0").withColumn("status", F.lit("required"))
    cap = g.filter("org % 2 = 1").withColumn("available", F.col("org") % 5 == 0)
    return J.institution_details(orgs, types, facts, req, ovr, cap, "org", "typ")


# --- aggregation ------------------------------------------------------------------------------

@query("agg1_group_aggregate", """
SELECT l_returnflag, l_linestatus, count(*) AS _count, round(sum(l_quantity), 2) AS "SUM(l_quantity)", round(avg(l_extendedprice), 4) AS "AVG(l_extendedprice)",
 min(l_discount) AS "MIN(l_discount)", max(l_tax) AS "MAX(l_tax)", count(*) AS "COUNT(l_tax)" FROM lineitem GROUP BY 1, 2""")
def _(t):
    out = A.group_aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [("l_quantity", "SUM"), ("l_extendedprice", "AVG"), ("l_discount", "MIN"), ("l_tax", "MAX"), ("l_tax", "COUNT")])
    return out.withColumn("SUM(l_quantity)", rnd("SUM(l_quantity)", 2))


SEG = "(SELECT CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS x, o_orderstatus AS s, o_totalprice AS v, o_custkey AS k, o_orderdate FROM orders)"


def _seg(t):
    return t.orders.select(F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderpriority")).alias("x"), F.col("o_orderstatus").alias("s"),
                           F.col("o_totalprice").alias("v"), F.col("o_custkey").alias("k"), "o_orderdate")


for _fn, _sqlfn in {"sum": "round(sum({}), 4)", "mean": "round(avg({}), 4)", "median": "round(quantile_cont({}, 0.5), 4)",
                    "count": "count({})", "count_distinct": "count(DISTINCT {})", "min": "round(min({}), 4)", "max": "round(max({}), 4)"}.items():
    def _make(fn):
        def run(t):
            out = C.chart_aggregate(_seg(t), "x", ["v", "k"], fn)
            if fn in ("sum", "mean", "median", "min", "max"):
                out = out.select("_x", rnd("v", 2).alias("v"), rnd(F.col("k").cast("double"), 2).alias("k"))
            return out
        return run
    _w = (lambda e: f"round({e}::DOUBLE, 2)") if _fn not in ("count", "count_distinct") else (lambda e: e)
    query(f"agg2_chart_{_fn}", f"SELECT coalesce(x, '{EMPTY}') AS _x, {_w(_sqlfn.format('v'))} AS v, {_w(_sqlfn.format('k'))} AS k FROM {SEG} GROUP BY 1")(_make(_fn))


@query("agg3_stacked_pct", f"""
WITH g AS (SELECT coalesce(x, '{EMPTY}') AS _x, round(sum(v), 4) AS v, round(sum(k)::DOUBLE, 4) AS k FROM {SEG} GROUP BY 1)
SELECT _x, round(v * 1000 / (v + k)) / 10 AS v, round(k * 1000 / (v + k)) / 10 AS k FROM g""")
def _(t):
    return C.stacked_pct(_seg(t), "x", ["v", "k"], "sum")


@query("agg4_part_of_whole", f"SELECT coalesce(x, '{EMPTY}') AS name, round(round(avg(v), 4), 2) AS value FROM {SEG} GROUP BY 1")
def _(t):
    return C.part_of_whole(_seg(t), "x", "v", "mean").withColumn("value", rnd("value", 2))


@query("agg5_histogram", """
WITH m AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS w FROM orders),
 c AS (SELECT least(19, floor((o_totalprice - lo) / w))::INT AS bin, count(*) AS n FROM orders, m GROUP BY 1)
SELECT r.range::INT AS bin, round(lo + r.range * w, 4) AS lo, round(lo + (r.range + 1) * w, 4) AS hi, coalesce(n, 0) AS count FROM range(20) r, m LEFT JOIN c ON c.bin = r.range""")
def _(t):
    return C.histogram(t.orders, "o_totalprice").withColumns({"lo": rnd("lo", 4), "hi": rnd("hi", 4)})


@query("agg6_heatmap", f"""
WITH b AS (SELECT coalesce(x, '{EMPTY}') AS x, CAST(year(o_orderdate) AS VARCHAR) AS y, v FROM {SEG}),
 c AS (SELECT x, y, round(sum(v), 2) AS value FROM b GROUP BY 1, 2),
 d AS (SELECT x, y, coalesce(value, 0) AS value FROM (SELECT * FROM (SELECT DISTINCT x FROM b), (SELECT DISTINCT y FROM b)) LEFT JOIN c USING (x, y))
SELECT x, y, value, (SELECT min(value) FROM d) AS min, (SELECT max(value) FROM d) AS max FROM d""")
def _(t):
    out = C.heatmap(_seg(t).withColumn("y", F.year("o_orderdate")), "x", "y", "v", "sum")
    return out.withColumns({c: rnd(c, 2) for c in ("value", "min", "max")})


@query("agg7_waterfall", f"""
WITH g AS (SELECT coalesce(x, '{EMPTY}') AS _x, sum(v - 190000) AS d FROM {SEG} GROUP BY 1), r AS (SELECT *, sum(d) OVER (ORDER BY _x) AS run FROM g)
SELECT _x, round(CASE WHEN d >= 0 THEN run - d ELSE run END, 2) AS base, round(abs(d), 2) AS delta, d >= 0 AS is_positive, round(run, 2) AS total FROM r""")
def _(t):
    out = C.waterfall(_seg(t).withColumn("v", F.col("v") - 190000), "x", "v", "sum")
    return out.withColumns({c: rnd(c, 2) for c in ("base", "delta", "total")})


@query("agg7_waterfall_order", f"""
WITH g AS (SELECT coalesce(x, '{EMPTY}') AS _x, sum(v - 190000) AS d, min(v) AS o FROM {SEG} GROUP BY 1), r AS (SELECT *, sum(d) OVER (ORDER BY o, _x) AS run FROM g)
SELECT _x, round(CASE WHEN d >= 0 THEN run - d ELSE run END, 2) AS base, round(abs(d), 2) AS delta, d >= 0 AS is_positive, round(run, 2) AS total FROM r""")
def _(t):
    out = C.waterfall(_seg(t).withColumn("o", F.col("v")).withColumn("v", F.col("v") - 190000), "x", "v", "sum", order="o")
    return out.withColumns({c: rnd(c, 2) for c in ("base", "delta", "total")})


@query("agg8_boxplot", f"""
WITH q AS (SELECT coalesce(x, '{EMPTY}') AS _x, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM {SEG} GROUP BY 1)
SELECT _x, round(min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)), 4) AS min, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
 round(max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)), 4) AS max FROM {SEG} b JOIN q ON coalesce(x, '{EMPTY}') = _x GROUP BY _x""")
def _(t):
    return C.boxplot_by(_seg(t), "x", "v").select("_x", *[rnd(c, 4).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query("agg9_pareto", """
WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS _x, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1),
 r AS (SELECT *, sum(l_quantity) OVER (ORDER BY l_quantity DESC, _x ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER () AS s FROM g)
SELECT _x, l_quantity, round(c / s * 1000) / 10 AS cum_pct FROM r""")
def _(t):
    return C.pareto(t.lineitem, "l_suppkey", "l_quantity", "sum")


@query("agg10_sankey", f"""
SELECT * FROM (SELECT coalesce(x, '{EMPTY}') AS source, s AS target, round(sum(v), 2) AS value FROM {SEG} GROUP BY 1, 2) WHERE source <> target AND value > 0""")
def _(t):
    return C.sankey(_seg(t), "x", "s", "v", "sum").withColumn("value", rnd("value", 2))


@query("agg10_sankey_counts", "SELECT l_returnflag AS source, l_linestatus AS target, count(*) AS value FROM lineitem WHERE l_returnflag <> l_linestatus GROUP BY 1, 2")
def _(t):
    return C.sankey(t.lineitem, "l_returnflag", "l_linestatus", None, "count")


@query("agg11_calendar", """
WITH y AS (SELECT year(o_orderdate) AS y FROM orders GROUP BY 1 ORDER BY count(DISTINCT CAST(o_orderdate AS DATE)) DESC, 1 LIMIT 1),
 d AS (SELECT CAST(o_orderdate AS DATE) AS day, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT CAST(CAST(r.range AS DATE) AS VARCHAR) AS day, value FROM y, range(make_date(y::INT, 1, 1)::TIMESTAMP, make_date(y::INT + 1, 1, 1)::TIMESTAMP, INTERVAL 1 DAY) r LEFT JOIN d ON d.day = CAST(r.range AS DATE)""")
def _(t):
    return C.calendar(t.orders, "o_orderdate", "o_totalprice", "sum").select(F.col("day").cast("string").alias("day"), rnd("value", 2).alias("value"))


@query("agg12_kpi", """
WITH g AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m DESC) AS rn FROM g)
SELECT round(a.v, 2) AS value, round(b.v, 2) AS prev_value, round((round(a.v, 4) - round(b.v, 4)) / round(b.v, 4) * 100, 4) AS change, a.m AS group_label, b.m AS prev_label FROM r a, r b WHERE a.rn = 1 AND b.rn = 2""")
def _(t):
    out = C.kpi(t.orders.withColumn("m", F.date_format("o_orderdate", "yyyy-MM")), "o_totalprice", "mean", "m")
    return out.withColumns({"value": rnd("value", 2), "prev_value": rnd("prev_value", 2), "change": rnd("change", 4)})


@query("agg12_kpi_total", "SELECT round(quantile_cont(o_totalprice, 0.5), 2) AS value FROM orders")
def _(t):
    return C.kpi(t.orders, "o_totalprice", "median").withColumn("value", rnd("value", 2))


@query("agg13_table_widget", f"SELECT coalesce(x, '{EMPTY}') AS _x, count(DISTINCT v) AS v, count(DISTINCT k) AS k FROM {SEG} GROUP BY 1")
def _(t):
    return C.table_widget(_seg(t), "x", ["v", "k"], "count_distinct", "value_desc")


@query("agg14_scatter", "SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y_l_extendedprice FROM lineitem")
def _(t):
    out = C.scatter(t.lineitem, "l_quantity", ["l_extendedprice"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return out.drop("l_partkey", "l_suppkey", "l_extendedprice")


@query("agg14_bubble", "SELECT o_orderkey, o_totalprice AS x, o_custkey::DOUBLE AS y, 1.0::DOUBLE AS r FROM orders")
def _(t):
    return C.bubble(t.orders, "o_totalprice", "o_custkey", ["o_orderkey"])


@query("agg15_xy_chart", "SELECT strftime(l_shipdate, '%Y-%m') AS _x, round(round(sum(l_quantity), 4), 2) AS l_quantity FROM lineitem GROUP BY 1")
def _(t):
    return C.xy_chart(t.lineitem.withColumn("m", F.date_format("l_shipdate", "yyyy-MM")), "m", ["l_quantity"], "sum", "name_asc").withColumn("l_quantity", rnd("l_quantity", 2))


@query("agg16_stacked_bar", """
WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS x, CAST(l_quantity::INT AS VARCHAR) AS stack, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT x, stack, n::DOUBLE AS value FROM c""")
def _(t):
    return C.stacked_bar(t.lineitem.withColumn("q", F.col("l_quantity").cast("int")), "l_suppkey", "q", None)


@query("agg17_distinct_values", "SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL ORDER BY 1")
def _(t):
    return A.distinct_values(t.part, "p_size")


@query("agg18_unique_values", "SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2")
def _(t):
    return A.unique_values(t.part, ["p_brand", "p_type"])


@query("agg18_unique_counts", "SELECT 'l_partkey' AS \"column\", count(DISTINCT l_partkey) AS \"unique\" FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate) FROM lineitem")
def _(t):
    return A.unique_counts(t.lineitem, ["l_partkey", "l_shipdate"])


@query("agg19_capped_count", "SELECT count(*) AS total, false AS capped FROM lineitem")
def _(t):
    return A.capped_count(t.lineitem)


@query("agg20_group_by_prefix", """
SELECT value, CASE WHEN regexp_matches(value, '^[0-9A-Za-z]') THEN upper(substr(value, 1, 1)) ELSE '#' END AS "group",
 CASE WHEN regexp_matches(value, '^[0-9]') THEN 0 WHEN regexp_matches(value, '^[A-Za-z]') THEN 1 ELSE 2 END AS group_order
FROM (SELECT DISTINCT trim(CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN CAST(p_partkey AS VARCHAR) ELSE '-' || p_name END) AS value FROM part)""")
def _(t):
    v = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("-"), "p_name"))
    return A.group_by_prefix(t.part.select(v.alias("v")), "v")


@query("agg21_icd9_group", """
WITH v AS (SELECT DISTINCT CASE p_size % 7 WHEN 0 THEN 'V' || p_partkey % 90 WHEN 1 THEN 'x' ELSE lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.' || p_size END AS value FROM part),
 s AS (SELECT unnest([1,140,240,280,290,320,390,460,520,580,630,680,710,740,760,780,800]) AS a, unnest([139,239,279,289,319,389,459,519,579,629,679,709,739,759,779,799,999]) AS b, unnest(range(17)) AS i),
 n AS (SELECT value, TRY_CAST(regexp_extract(value, '^[^0-9]*([0-9]{1,3})', 1) AS INT) AS k FROM v)
SELECT value, CASE WHEN value LIKE 'V%' THEN 'EV' WHEN a IS NULL THEN 'OTHER' ELSE lpad(CAST(a AS VARCHAR), 3, '0') || '-' || b END AS "group",
 CASE WHEN value LIKE 'V%' THEN 17 WHEN a IS NULL THEN 18 ELSE i END::INT AS group_order FROM n LEFT JOIN s ON k BETWEEN a AND b AND value NOT LIKE 'V%'""")
def _(t):
    m = F.col("p_size") % 7
    v = F.when(m == 0, F.concat(F.lit("V"), F.col("p_partkey") % 90)).when(m == 1, "x").otherwise(
        F.concat(F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("."), "p_size"))
    return A.icd9_group(t.part.select(v.alias("code")), "code")


@query("agg22_guarded_denominator", """
WITH f AS (SELECT o_orderpriority AS k, o_orderstatus <> 'P' AS c, o_totalprice AS num, CASE WHEN o_orderpriority = '5-LOW' AND o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS den FROM orders)
SELECT k, round(sum(num) FILTER (c), 2) AS numerator, count(*) FILTER (c) AS organizations, count(*) FILTER (c AND den IS NOT NULL) AS with_denominator,
 CASE WHEN count(*) FILTER (c) = count(*) FILTER (c AND den IS NOT NULL) THEN CAST(sum(den) FILTER (c) AS BIGINT) END AS denominator FROM f GROUP BY k""")
def _(t):
    d = t.orders.select(F.col("o_orderpriority").alias("k"), "o_orderstatus", F.col("o_totalprice").alias("num"),
                        F.when(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_custkey") % 10 == 0)), F.col("o_custkey")).alias("den"))
    return A.guarded_denominator(d, ["k"], F.col("o_orderstatus") != "P", "num", "den").withColumn("numerator", rnd("numerator", 2))


WIDE = "SELECT l_suppkey AS org, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R' AND l_quantity > 49) AS \"R\" FROM lineitem GROUP BY 1"


@query("agg23_unpivot_facts", f"SELECT org, type_code, document_count FROM (UNPIVOT ({WIDE}) ON \"A\", \"N\", \"R\" INTO NAME type_code VALUE document_count) WHERE document_count > 0")
def _(t):
    wide = t.lineitem.groupBy(F.col("l_suppkey").alias("org")).agg(*[F.count_if(c).alias(k) for k, c in {
        "A": F.col("l_returnflag") == "A", "N": F.col("l_returnflag") == "N", "R": (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)}.items()])
    return A.unpivot_facts(wide, ["org"], ["A", "N", "R"])


GROUPS = "SELECT DISTINCT p_brand AS typ, substr(p_brand, 1, 7) AS group_key, TRY_CAST(substr(p_brand, 7, 1) AS INT) AS position FROM part"
BRANDED = "SELECT l_suppkey AS org, p_brand AS typ, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"


def _branded(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("org"), F.col("p_brand").alias("typ")).agg(F.count(F.lit(1)).alias("n"))


def _groups(t):
    return t.part.select(F.col("p_brand").alias("typ"), F.substring("p_brand", 1, 7).alias("group_key"), F.substring("p_brand", 7, 1).try_cast("int").alias("position")).distinct()


@query("agg24_group_numerator_max", f"""
WITH j AS (SELECT group_key, position, org, sum(n) AS n FROM ({BRANDED}) JOIN ({GROUPS}) USING (typ) GROUP BY 1, 2, 3),
 b AS (SELECT group_key FROM j GROUP BY group_key, position ORDER BY sum(n) DESC, position LIMIT 1)
SELECT org, CAST(sum(n) AS BIGINT) AS numerator FROM j WHERE group_key IN (SELECT group_key FROM b) GROUP BY org""")
def _(t):
    return A.group_numerator(_branded(t), _groups(t), A.rule_at([{"from": "2024-01-01", "rule": "sum"}, {"from": "2025-01-01", "rule": "max"}], "2025-06-01"), "org", "typ", "n")


@query("agg24_group_numerator_sum", f"SELECT org, CAST(sum(n) AS BIGINT) AS numerator FROM ({BRANDED}) JOIN ({GROUPS}) USING (typ) GROUP BY org")
def _(t):
    return A.group_numerator(_branded(t), _groups(t), "sum", "org", "typ", "n")


# --- windows and order ------------------------------------------------------------------------

@query("win1_first_per_key", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return K.first_per(t.orders, ["o_custkey"], ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win1_row_number", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events")
def _(t):
    return K.numbered_per(t.events, ["event_type"], ["ts", "event_id"]).select("event_id", "rn")


@query("win2_latest_per_key", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, ts DESC, event_id DESC")
def _(t):
    return K.latest_per_key(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("win3_latest_import", "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders ORDER BY o_orderdate DESC, o_custkey DESC LIMIT 1)")
def _(t):
    return K.latest_import(t.orders, "o_custkey", "o_orderdate").select("o_orderkey")


MONTHLY = "SELECT l_suppkey % 10 AS org, year(l_shipdate) AS period_id, month(l_shipdate)::INT AS month, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"


@query("win4_latest_cumulative", f"""
WITH m AS (SELECT * FROM ({MONTHLY}) WHERE period_id <> 1995), l AS (SELECT period_id, max(month) AS last FROM m GROUP BY 1)
SELECT org, period_id, n, month FROM m JOIN l USING (period_id) WHERE month = last UNION ALL SELECT org, period_id, sum(n)::BIGINT, NULL FROM ({MONTHLY}) WHERE period_id NOT IN (SELECT period_id FROM l) GROUP BY 1, 2""")
def _(t):
    m = t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("org"), F.year("l_shipdate").alias("period_id"), F.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return K.latest_cumulative(m.filter("period_id <> 1995"), m.groupBy("org", "period_id").agg(F.sum("n").alias("n")), "period_id").select("org", "period_id", "n", "month")


@query("win5_avg_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS avg_rank FROM lineitem")
def _(t):
    return K.with_avg_rank(t.lineitem, "l_quantity").select("l_orderkey", "l_linenumber", "avg_rank")


@query("win6_rolling", """
SELECT event_id, CASE WHEN count(value) OVER w = 5 THEN round(avg(value) OVER w, 6) END AS rolling_mean, CASE WHEN count(value) OVER w = 5 THEN round(stddev_pop(value) OVER w, 6) END AS rolling_std
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(t):
    return K.rolling(t.events, "value", 5, ["ts", "event_id"], ["user_id"]).select("event_id", rnd("rolling_mean", 6).alias("rolling_mean"), rnd("rolling_std", 6).alias("rolling_std"))


@query("win7_lag_pairs", "SELECT * FROM (SELECT event_id, lag(value, 3) OVER (ORDER BY ts, event_id) AS x, value AS y FROM events) WHERE x IS NOT NULL")
def _(t):
    return K.lag_pairs(t.events, "value", 3, ["ts", "event_id"]).select("event_id", "x", "y")


@query("srt1_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    return K.page(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "desc", 50, 100, ["o_orderkey"])


@query("srt2_joined_page", """
SELECT o_orderkey AS "orders.orderkey", l_linenumber AS "lineitem.l_linenumber", l_quantity AS "lineitem.l_quantity" FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey
ORDER BY l_quantity, o_orderkey, l_linenumber LIMIT 40 OFFSET 20""")
def _(t):
    cols = ["orders.orderkey", "lineitem.l_linenumber", "lineitem.l_quantity"]
    return K.page(R.project_joined(_clinical(t), cols), "lineitem.l_quantity", "asc", 40, 20, cols[:2])


def _placed(t, ordered):
    """The rows of an ordered table with their place in it, as the operator left them: written in that order, then numbered."""
    kept = sinks.stage(ordered.withColumn("__at", F.monotonically_increasing_id()), _roundtrip(t, ordered, "ordered"))
    return row_numbers(kept, ["__at"], out="place").drop("__at")


@query("srt3_rank_orgs", "SELECT s_name AS organization_name, s_acctbal / 80 AS fact_value, row_number() OVER (ORDER BY s_acctbal / 80 DESC, s_name) AS place FROM supplier WHERE s_suppkey % 5 <> 0 AND s_acctbal / 80 >= 100")
def _(t):
    d = t.supplier.select(F.col("s_name").alias("organization_name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 80).alias("fact_value"))
    return _placed(t, K.rank_orgs(d, "desc", "performed"))


@query("srt3_rank_orgs_ascending", "SELECT s_name AS organization_name, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 80 END AS fact_value, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 80 END NULLS LAST, s_name) AS place FROM supplier")
def _(t):
    d = t.supplier.select(F.col("s_name").alias("organization_name"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 80).alias("fact_value"))
    return _placed(t, K.rank_orgs(d, "asc"))


@query("srt4_rank_types", """
SELECT p_partkey AS code, p_size % 4 = 0 AS is_problem, row_number() OVER (ORDER BY CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 7 = 0 THEN 4 ELSE 3 END, p_partkey) AS place FROM part""")
def _(t):
    d = t.part.select(F.col("p_partkey").alias("code"), (F.col("p_size") % 4 == 0).alias("is_problem"), (F.col("p_size") % 5 == 0).alias("is_manual"),
                      F.when(F.col("p_size") % 3 == 0, "required").when(F.col("p_size") % 7 == 0, "optional").otherwise("unknown").alias("requirement_status"))
    out = K.rank_types(d.withColumn("code", F.col("code").cast("string")), "code")
    return _placed(t, out.select(F.col("code").cast("long").alias("code"), "is_problem"))


@query("srt5_top_k", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 10")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


@query("srt6_list_findings", """
SELECT o_orderkey AS finding_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS type_name,
 row_number() OVER (ORDER BY CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_totalprice > 150000 THEN 1 ELSE 2 END, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END NULLS FIRST, o_orderdate, o_orderkey) AS place
FROM orders WHERE year(o_orderdate) = 1996 AND o_orderstatus = 'F'""")
def _(t):
    severity = F.when(F.col("o_totalprice") > 300000, "error").when(F.col("o_totalprice") > 150000, "warning").otherwise("info")
    d = t.orders.select(F.col("o_orderkey").alias("finding_id"), F.year("o_orderdate").cast("string").alias("period_id"), (F.col("o_orderstatus") == "F").alias("is_active"),
                        F.col("o_custkey").alias("organization_oid"), severity.alias("severity"),
                        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("type_name"), F.col("o_orderdate").alias("created_at"))
    return _placed(t, K.list_findings(d, "1996").select("finding_id", "type_name"))


# --- sets -------------------------------------------------------------------------------------

@query("set1_union_findings", "SELECT s_suppkey AS org, 'negative_balance' AS finding_code FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'no_lines' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09) ")
def _(t):
    a = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("org"), F.lit("negative_balance").alias("finding_code"))
    big = t.lineitem.filter("l_quantity > 49 AND l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    b = t.supplier.join(big, "s_suppkey", "left_anti").select(F.col("s_suppkey").alias("org"), F.lit("no_lines").alias("finding_code"))
    return a.unionByName(b)


@query("set2_set_diff", """
WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE year(l_shipdate) = 1996)
SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)""")
def _(t):
    y = lambda n: t.lineitem.filter(F.year("l_shipdate") == n)
    return A.set_diff(y(1995), y(1996), ["l_suppkey", "l_partkey"])


@query("set3_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def _(t):
    return A.intersection(t.lineitem.filter("l_returnflag = 'A'"), t.lineitem.filter("l_returnflag = 'R'"), ["l_partkey"])


@query("set4_duplicates", "SELECT CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS members, CAST(sum(c - 1) AS BIGINT) AS extras FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_quantity, l_discount)")
def _(t):
    return A.duplicates(t.lineitem.select("l_suppkey", "l_quantity", "l_discount"))


# --- scalar functions -------------------------------------------------------------------------

@query("sca1_parse_number", "SELECT c_custkey, c_acctbal AS v FROM customer")
def _(t):
    txt = F.concat(F.lit(" "), F.regexp_replace(F.col("c_acctbal").cast("string"), r"\.", ","), F.lit(" "))
    return t.customer.select("c_custkey", parse.parse_number(txt).alias("v"))


@query("sca2_parse_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS ts FROM orders")
def _(t):
    m = F.col("o_orderkey") % 3
    d = F.when(m == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(m == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    s = F.when(m == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return t.orders.select("o_orderkey", parse.parse_date(d).cast("string").alias("d"), F.date_format(parse.parse_datetime(s), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("sca3_parse_time", "SELECT event_id, strftime(ts, '%H:%M:00') AS tod FROM events")
def _(t):
    txt = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "h:mm a")).otherwise(F.date_format("ts", "H:mm"))
    return t.events.select("event_id", parse.parse_time(txt).alias("tod"))


@query("sca4_classify", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'time' WHEN 1 THEN 'date' WHEN 2 THEN 'datetime' END AS kind FROM events")
def _(t):
    m = F.col("event_id") % 4
    txt = F.when(m == 0, F.date_format("ts", "HH:mm")).when(m == 1, F.date_format("ts", "dd/MM/yyyy")).when(m == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("event_type"))
    return t.events.select("event_id", parse.classify(txt).alias("kind"))


@query("sca5_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def _(t):
    return t.orders.select("o_orderkey", parse.iso_week(F.col("o_orderdate")).alias("week"))


@query("sca6_parse_age", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size WHEN 1 THEN 90 END AS age FROM part")
def _(t):
    m = F.col("p_size") % 3
    return t.part.select("p_partkey", text.parse_age(F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, "> 89").otherwise("")).alias("age"))


KEYED = "lower(trim(regexp_replace(replace(regexp_replace(p_name || ' №' || p_partkey || ' «' || p_brand || '» Ёж', '[«»\"]', '{}', 'g'), '№', ' '), '[^a-zA-Z0-9а-яА-ЯёЁ]+', ' ', 'g')))"


def _titles(t):
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" №"), "p_partkey", F.lit(" «"), "p_brand", F.lit("» Ёж")).alias("title"))


@query("sca7_name_key", f"SELECT p_partkey, replace(replace({KEYED.format('')}, 'ё', 'е'), ' ', '_') AS key FROM part")
def _(t):
    return _titles(t).select("p_partkey", text.name_key(F.col("title")).alias("key"))


@query("sca8_org_key", f"SELECT p_partkey, replace({KEYED.format(' ')}, 'ё', 'е') AS key FROM part")
def _(t):
    return _titles(t).select("p_partkey", text.org_key(F.col("title")).alias("key"))


@query("sca9_name_variants", "SELECT p_partkey, 'гбу ' || lower(replace(p_name, '-', ' ')) AS full_key, lower(replace(p_name, '-', ' ')) AS short_key FROM part")
def _(t):
    v = text.name_variants(F.concat(F.lit("ГБУ «"), "p_name", F.lit("»")))
    return t.part.select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")[0].alias("full_key"), F.col("v")[1].alias("short_key"))


@query("sca10_strip_version", "SELECT p_partkey, p_name AS v FROM part")
def _(t):
    return t.part.select("p_partkey", text.strip_version(F.concat("p_name", F.lit(" (CDA) Редакция "), "p_size")).alias("v"))


@query("sca11_section_code", "SELECT p_partkey, p_size || '.' || p_partkey AS v FROM part")
def _(t):
    return t.part.select("p_partkey", text.section_code(F.concat(F.lit(" "), "p_size", F.lit("."), "p_partkey", F.lit(" title"))).alias("v"))


@query("sca12_percent", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 5 > 0 THEN round(l_tax / (l_quantity - 5) * 10000) / 100 END AS p FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", percent(F.col("l_tax"), F.col("l_quantity") - 5).alias("p"))

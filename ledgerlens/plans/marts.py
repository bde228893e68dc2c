"""Queries on marts and composite choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts
from .base import WITH_ORDERS, order_years, query, table
from .cells import cells


@query("segment_sums", """
WITH f AS (SELECT l_orderkey, l_returnflag AS element, l_suppkey % 3 AS context, l_linestatus = 'F' AS broad, l_quantity AS value, l_linenumber * 1000000 + l_partkey AS ord FROM lineitem WHERE l_returnflag IN ('R', 'A')),
p AS (SELECT *, min(CASE element WHEN 'R' THEN 1 ELSE 2 END) OVER (PARTITION BY l_orderkey) AS b FROM f),
q AS (SELECT * FROM p WHERE b = CASE element WHEN 'R' THEN 1 ELSE 2 END),
w AS (SELECT *, bool_or(broad) OVER (PARTITION BY l_orderkey) AS any_broad FROM q),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, context ORDER BY ord) AS k FROM w WHERE broad = any_broad)
SELECT l_orderkey, min(element) AS element, sum(value) AS value, count(*) AS parts, string_agg(CAST(ord AS VARCHAR), ' / ' ORDER BY ord) AS quotes FROM o WHERE k = 1 GROUP BY 1""")
def segment_sums(spark, sf):
    ord_ = F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")
    facts = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("element"), (F.col("l_suppkey") % 3).alias("context"), (F.col("l_linestatus") == "F").alias("broad"), F.col("l_quantity").alias("value"), F.lit("u").alias("unit"), ord_.cast("string").alias("quote"), ord_.alias("ord"))
    return marts.segment_sum(facts, ["l_orderkey"], ["R", "A"]).select("l_orderkey", "element", "value", "parts", "quotes")


@query("scoped_lookup", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'urgent_done' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'other' END AS field FROM orders""")
def scoped_lookup(spark, sf):
    entries = spark.createDataFrame([(0, "F|1-URGENT", "urgent_done"), (1, "1-URGENT", "urgent"), (2, "O", "open")], "level int, key string, field string")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return marts.scoped_lookup(rows, entries, [["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], ["o_orderstatus"]], "field", "other").select("o_orderkey", "field")


@query("target_coverage", """
WITH e AS (SELECT CAST(c_custkey AS VARCHAR) AS entity FROM customer), m AS (SELECT unnest(['F', 'P']) AS metric),
d AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderstatus AS metric, count(*) AS n, max(year(o_orderdate)) AS y FROM orders GROUP BY 1, 2)
SELECT e.entity, m.metric, coalesce(d.n, 0) AS documents, coalesce(p.n, 0) AS parsed, CAST(p.y AS INTEGER) AS latest_year, CASE WHEN p.n > 0 THEN 'covered' WHEN d.n > 0 THEN 'document_only' ELSE 'missing' END AS status
FROM e CROSS JOIN m LEFT JOIN d ON d.entity = e.entity LEFT JOIN p ON p.entity = e.entity AND p.metric = m.metric""")
def target_coverage(spark, sf):
    """Every order is a document and a parsed row of its status: customers without orders miss both, others may lack a status."""
    entities = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderstatus").alias("metric"), F.year("o_orderdate").alias("year"))
    return marts.target_coverage(entities, ["F", "P"], orders, orders)


@query("upsert_keeping_created", """
WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS created, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS created, min(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT coalesce(b.k, a.k) AS k, coalesce(a.created, b.created) AS created, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k""")
def upsert_keeping_created(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    old = o.where("o_orderkey % 2 = 0").groupBy("k").agg(F.min("o_orderkey").alias("created"), F.max("o_totalprice").alias("v"))
    new = o.where("o_orderkey % 2 = 1").groupBy("k").agg(F.max("o_orderkey").alias("created"), F.min("o_totalprice").alias("v"))
    return marts.upsert_keeping(old, new, ["k"], "created")


@query("reconciliation_groups", WITH_ORDERS + """
SELECT CASE WHEN year % 2 = 0 THEN 'even' ELSE 'odd' END AS group_id, count(*) AS items, count(DISTINCT entity || year) AS entity_years, count(DISTINCT field_id) AS fields FROM c WHERE field_id <> 'total' GROUP BY 1""")
def reconciliation_groups(spark, sf):
    why = F.concat(F.lit("x;identity_group_mismatch:"), F.when(F.col("year") % 2 == 0, "even").otherwise("odd"))
    queue = cells(spark, sf).withColumn("review_reason", F.when(F.col("field_id") != "total", why).otherwise("validation_fail"))
    return marts.reconciliation_groups(queue).drop("samples")


@query("low_coverage_fields", "SELECT p_brand AS field_id, count(CASE WHEN p_partkey % 40 = 0 THEN 1 END) AS values, CASE WHEN count(CASE WHEN p_partkey % 40 = 0 THEN 1 END) = 0 THEN 'info' ELSE 'low' END AS severity FROM part GROUP BY 1 HAVING count(CASE WHEN p_partkey % 40 = 0 THEN 1 END) < 3")
def low_coverage_fields(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("field_id"), F.when(F.col("p_partkey") % 40 == 0, 1.0).alias("value"))
    return marts.low_coverage(parts.select("field_id").distinct(), parts, 3)


@query("reproduction_rate", "SELECT l_suppkey, count(*) AS cells, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM lineitem GROUP BY 1")
def reproduction_rate(spark, sf):
    return marts.reproduction_rate(table(spark, sf, "lineitem").select("l_suppkey", "l_discount"), ["l_suppkey"], "l_discount", 0.05)


@query("latest_period", "SELECT 'P' || max(year(o_orderdate)) AS period FROM orders")
def latest_period(spark, sf):
    return marts.latest(table(spark, sf, "orders").select(F.concat(F.lit("P"), F.year("o_orderdate").cast("string")).alias("period")), "period")


@query("audit_projection", WITH_ORDERS + "SELECT entity, year, field_id, CASE WHEN field_id = 'total' THEN 'Total' ELSE field_id END AS field_name, CAST(NULL AS VARCHAR) AS source_file FROM c")
def audit_projection(spark, sf):
    names = spark.createDataFrame([("total", "Total")], "field_id string, field_name string")
    return marts.audit_projection(cells(spark, sf), names, ["entity", "year", "field_id", "field_name", "source_file"])


@query("wide_with_master", WITH_ORDERS + """,
k AS (SELECT n_name AS entity, 2002 AS year FROM nation UNION SELECT entity, year FROM y)
SELECT entity, year, total FROM k LEFT JOIN y USING (entity, year)""")
def wide_with_master(spark, sf):
    """The master's rows are the spine; rows it does not know are appended."""
    master = table(spark, sf, "nation").select(F.col("n_name").alias("entity"), F.lit(2002).alias("year"))
    return master.join(order_years(spark, sf).select("entity", "year", "total"), ["entity", "year"], "full_outer")

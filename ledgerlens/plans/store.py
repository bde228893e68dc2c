"""Queries on the mapping store, calendars, table texts and composite reads.

The test tables stand in for the store: parts are observed items (their brand the element), nations are concepts, and a
customer maps the item of its key to the concept of its nation, the last five nations to those of the first, so that some
concepts have no mapping.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, mapping, reads, schedule, tables
from .base import WITH_ORDERS, order_years, query, spread, table
from .cells import CELL, cells


def items(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("element"), F.col("p_type").alias("unit"))


def concepts(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("concept"), F.col("n_name").alias("name"), F.lit("active").alias("status"))


def mappings(spark, sf):
    key = F.col("c_custkey")
    state = F.when(key % 4 == 0, "confirmed").when(key % 4 == 1, "rejected").otherwise("proposed")
    who = F.when(key % 3 == 0, "model:a").otherwise("person")
    return table(spark, sf, "customer").select(key.alias("mapping"), (key % 900).alias("item"), (F.col("c_nationkey") % 20).cast("long").alias("concept"), F.when(key % 5 == 0, "new_concept").otherwise("map").alias("action"), state.alias("status"), who.alias("decided_by"), ((key % 10) / 10).alias("confidence"))


STORE = """
WITH items AS (SELECT p_partkey AS item, p_brand AS element, p_type AS unit FROM part),
concepts AS (SELECT CAST(n_nationkey AS BIGINT) AS concept, n_name AS name, 'active' AS status FROM nation),
m AS (SELECT c_custkey AS mapping, c_custkey % 900 AS item, CAST(c_nationkey % 20 AS BIGINT) AS concept, CASE WHEN c_custkey % 5 = 0 THEN 'new_concept' ELSE 'map' END AS action,
  CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'proposed' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'model:a' ELSE 'person' END AS decided_by, (c_custkey % 10) / 10 AS confidence
  FROM customer),
v AS (SELECT mapping, CASE mapping % 7 WHEN 0 THEN 'corroborated' WHEN 1 THEN 'conflicts' ELSE 'weak' END AS verdict FROM m)
"""


def verdicts(spark, sf):
    k = F.col("mapping") % 7
    return mappings(spark, sf).select("mapping", F.when(k == 0, "corroborated").when(k == 1, "conflicts").otherwise("weak").alias("verdict"))


@query("unmapped_items", STORE + "SELECT * FROM items WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.item = items.item AND (status = 'confirmed' OR (status = 'proposed' AND starts_with(decided_by, 'model:'))))")
def unmapped_items(spark, sf):
    return mapping.unmapped(items(spark, sf), mappings(spark, sf))


@query("confirmed_hints", STORE + "SELECT element, concept, count(*) AS uses FROM items JOIN m USING (item) WHERE status = 'confirmed' GROUP BY 1, 2")
def confirmed_hints(spark, sf):
    return mapping.hints(items(spark, sf), mappings(spark, sf))


@query("promote_proposals", STORE + "SELECT mapping, CASE WHEN status = 'proposed' AND action = 'map' AND verdict = 'corroborated' THEN 'confirmed' ELSE status END AS status, CASE WHEN status = 'proposed' AND action = 'map' AND verdict = 'corroborated' THEN 'numbers' ELSE decided_by END AS decided_by FROM m JOIN v USING (mapping)")
def promote_proposals(spark, sf):
    return mapping.promote(mappings(spark, sf), verdicts(spark, sf)).select("mapping", "status", "decided_by")


@query("reject_conflicts", STORE + "SELECT mapping, CASE WHEN status = 'proposed' AND action = 'map' AND verdict = 'conflicts' THEN 'rejected' ELSE status END AS status FROM m JOIN v USING (mapping)")
def reject_conflicts(spark, sf):
    return mapping.reject_conflicts(mappings(spark, sf), verdicts(spark, sf), "r").select("mapping", "status")


@query("new_concepts", STORE + "SELECT name, string_agg(mapping, ',' ORDER BY mapping) AS mappings, min(mapping) AS first_mapping, 'concept_' || left(sha1(name), 16) AS concept FROM (SELECT m.mapping, c.name FROM m JOIN concepts c USING (concept) WHERE action = 'new_concept') GROUP BY name")
def new_concepts(spark, sf):
    named = mappings(spark, sf).join(concepts(spark, sf).select("concept", "name"), "concept")
    return mapping.new_concepts(named).withColumn("mappings", F.array_join("mappings", ","))


@query("merge_concept", STORE + "SELECT mapping, CASE WHEN concept = 3 AND status <> 'rejected' THEN 4 ELSE concept END AS concept FROM m")
def merge_concept(spark, sf):
    moved, _ = mapping.merge_concept(mappings(spark, sf).withColumn("concept", F.col("concept").cast("string")), concepts(spark, sf).withColumn("concept", F.col("concept").cast("string")), "3", "4")
    return moved.select("mapping", F.col("concept").cast("long").alias("concept"))


@query("concept_stats", STORE + "SELECT concept, count(mapping) AS mappings, count(*) FILTER (m.status = 'confirmed') AS confirmed, count(*) FILTER (m.status = 'proposed') AS proposed, coalesce(any_value(f.n), 0) AS final_values FROM concepts LEFT JOIN m USING (concept) LEFT JOIN (SELECT CAST(c_nationkey AS BIGINT) AS concept, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) f USING (concept) GROUP BY concept")
def concept_stats(spark, sf):
    values = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("field_id"), F.when(F.col("c_custkey") % 2 == 0, 1.0).alias("value"))
    return mapping.concept_stats(concepts(spark, sf), mappings(spark, sf), values)


@query("mapping_coverage", STORE + """,
k AS (SELECT item, bool_or(status = 'confirmed') AS sure FROM m GROUP BY 1)
SELECT count(*) AS items, count(sure) AS mapped, count(*) FILTER (sure) AS confirmed, count(*) - count(sure) AS unmapped, (SELECT count(*) FROM concepts WHERE concept NOT IN (SELECT concept FROM m)) AS concepts_without_mapping FROM items LEFT JOIN k USING (item)""")
def mapping_coverage(spark, sf):
    return mapping.coverage(items(spark, sf), mappings(spark, sf), concepts(spark, sf))


@query("open_proposals", STORE + "SELECT mapping, element, c.name AS concept_name, confidence FROM m LEFT JOIN items USING (item) LEFT JOIN concepts c USING (concept) WHERE m.status = 'proposed' AND confidence >= 0.5")
def open_proposals(spark, sf):
    return mapping.proposals(mappings(spark, sf), items(spark, sf), concepts(spark, sf), 0.5).select("mapping", "element", "concept_name", "confidence")


@query("definition_enrichment", STORE + """,
s AS (SELECT concept AS field_id, list_sort(list(DISTINCT element)) AS found FROM m JOIN items USING (item) WHERE status = 'confirmed' GROUP BY 1)
SELECT field_id, array_to_string([x for x in found if x <> 'Brand#1'], ',') AS added FROM s WHERE len([x for x in found if x <> 'Brand#1']) > 0""")
def definition_enrichment(spark, sf):
    fields = concepts(spark, sf).select(F.col("concept").alias("field_id"), F.array(F.lit("Brand#1")).alias("tags"))
    return mapping.enrichment(fields, mappings(spark, sf), items(spark, sf)).select("field_id", F.array_join("added", ",").alias("added"))


@query("filing_windows", """
WITH w(name, sm, sd, em, ed) AS (VALUES ('spring', 6, 1, 8, 15), ('winter', 12, 20, 2, 10)), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS today FROM orders),
x AS (SELECT today, name, y, make_date(y, sm, sd) AS a, CASE WHEN make_date(y, em, ed) < make_date(y, sm, sd) THEN make_date(y + 1, em, ed) ELSE make_date(y, em, ed) END AS b FROM d, w, range(1980, 2030) t(y) WHERE y BETWEEN year(today) - 1 AND year(today) + 2)
SELECT CAST(today AS VARCHAR) AS today, name, CAST(y - 1 AS INTEGER) AS target_year, today BETWEEN a AND b AS in_window FROM x""")
def filing_windows(spark, sf):
    windows = spark.createDataFrame([("spring", 6, 1, 8, 15), ("winter", 12, 20, 2, 10)], "name string, start_month int, start_day int, end_month int, end_day int")
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()
    out = schedule.filing_windows(days.crossJoin(F.broadcast(windows)), F.col("today"), ["today"])  # two windows
    return out.select(F.col("today").cast("string").alias("today"), "name", "target_year", "in_window")


@query("refresh_due", "SELECT o_orderkey, strftime(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH), '%Y-%m') AS target_month, day(o_orderdate) >= 5 AND '1996-03' < strftime(last_day(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH), '%Y-%m') AS due FROM orders")
def refresh_due(spark, sf):
    today = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(schedule.target_month_end(today), "yyyy-MM").alias("target_month"), schedule.refresh_due(today, F.lit("1996-03")).alias("due"))


@query("fetch_ranges", """
WITH s AS (SELECT c_custkey AS security, DATE '1994-01-01' AS listed_from, CASE WHEN c_custkey % 3 = 0 THEN DATE '1996-06-30' ELSE DATE '9999-12-31' END AS listed_to FROM customer),
l AS (SELECT o_custkey AS security, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1),
r AS (SELECT security, greatest(coalesce(last, DATE '1995-01-01'), listed_from) AS a, least(DATE '1998-12-31', listed_to) AS b FROM s LEFT JOIN l USING (security))
SELECT security, CAST(a AS VARCHAR) AS from_date, CAST(b AS VARCHAR) AS to_date FROM r WHERE a <= b""")
def fetch_ranges(spark, sf):
    day = lambda d: F.lit(d).cast("date")
    securities = table(spark, sf, "customer").select(F.col("c_custkey").alias("security"), day("1994-01-01").alias("listed_from"), F.when(F.col("c_custkey") % 3 == 0, day("1996-06-30")).otherwise(day("9999-12-31")).alias("listed_to"))
    stored = table(spark, sf, "orders").select(F.col("o_custkey").alias("security"), F.to_date("o_orderdate").alias("date"))
    out = schedule.fetch_range(securities, stored, day("1995-01-01"), day("1998-12-31"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("from_date", "to_date")})


@query("roll_forward_rows", WITH_ORDERS + "SELECT entity, 2005 AS year, arg_max(orders, year) AS orders, CAST(NULL AS DOUBLE) AS total FROM y GROUP BY 1 HAVING count(*) FILTER (year = 2005) = 0")
def roll_forward_rows(spark, sf):
    return schedule.roll_forward(order_years(spark, sf).select("entity", "year", "orders", "total"), 2005, ["total"])


@query("row_order_identity", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 AS a, l_extendedprice AS b, l_extendedprice * l_discount AS c, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 100 + l_extendedprice - l_extendedprice * l_discount ELSE l_extendedprice END AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(a + b - c - d) <= greatest(2.0, abs(d) * 0.001) THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END AS confidence, NOT (abs(a + b - c - d) <= greatest(2.0, abs(d) * 0.001)) AS review_required FROM x""")
def row_order_identity(spark, sf):
    a, b = F.col("l_quantity") * 100, F.col("l_extendedprice")
    c = b * F.col("l_discount")
    row = tables.order_row(F.array(a, b, c, F.when(F.col("l_linenumber") % 2 == 0, a + b - c).otherwise(b)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", row.alias("r")).select("l_orderkey", "l_linenumber", "r.confidence", "r.review_required")


@query("recovery_classes", """
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS value FROM orders), f AS (SELECT l_orderkey AS k, count(DISTINCT l_quantity) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT c.k, CASE WHEN value IS NOT NULL THEN 'already_filled' WHEN n = 1 THEN 'recoverable_high' WHEN n > 1 THEN 'recoverable_low' ELSE 'not_found' END AS recovery FROM c LEFT JOIN f USING (k)""")
def recovery_classes(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("value"))
    found = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("amount"))
    return tables.recovery(own, found, ["k"]).select("k", "recovery")


@query("reverse_lookup", """
SELECT o_orderkey AS k, 'price' AS field_id, l_linenumber AS block, l_returnflag AS role, round(CASE WHEN l_linestatus = 'F' THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END - CASE WHEN l_linenumber % 2 = 0 THEN 0::DOUBLE ELSE 0.2::DOUBLE END, 2) AS confidence
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE abs(o_totalprice - l_extendedprice) <= greatest(1.0, abs(o_totalprice) * 0.001)""")
def reverse_lookup(spark, sf):
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit("price").alias("field_id"), F.col("o_totalprice").alias("value"))
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("block"), F.col("l_returnflag").alias("role"), F.col("l_extendedprice").alias("amount"), (F.col("l_linestatus") == "F").alias("fitted"), (F.col("l_linenumber") % 2 == 0).alias("consistent"))
    return tables.reverse_lookup(own, found, ["k"])


@query("melted_table", WITH_ORDERS + "SELECT year, entity AS category, period, amount FROM (SELECT entity, year, 'f' AS period, round(total_f, 0) AS amount FROM y UNION ALL SELECT entity, year, 'o', round(total_o, 0) FROM y) WHERE amount IS NOT NULL")
def melted_table(spark, sf):
    rows = order_years(spark, sf).select("entity", "year", *[F.round(c, 0).cast("decimal(20,0)").cast("string").alias(c) for c in ("total_f", "total_o")])
    return tables.melt(rows, ["year"], "entity", {"total_f": "f", "total_o": "o"})


@query("label_runs", """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS DOUBLE) AS q, CAST(floor(l_extendedprice) AS DOUBLE) AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, 0 AS place, 'q' AS field_id, 'quantity' AS label, CAST(q AS VARCHAR) AS numbers FROM r UNION ALL SELECT l_orderkey, l_linenumber, 1, 'p', 'price', p || '|-' FROM r UNION ALL SELECT l_orderkey, l_linenumber, 2, 't', 'price total', CAST(l_orderkey AS DOUBLE) || '' FROM r""")
def label_runs(spark, sf):
    """Labels and the numbers behind them in texts made of line items."""
    text = F.concat_ws(" ", F.lit("quantity"), F.floor("l_quantity").cast("string"), F.lit("price"), F.floor("l_extendedprice").cast("string"), F.lit("－ price total"), F.col("l_orderkey").cast("string"))
    rows = spread(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", text.alias("t"))
    out = tables.label_runs(rows, ["l_orderkey", "l_linenumber"], "t", {"q": ["quantity"], "p": ["price"], "t": ["price total"]})
    numbers = F.array_join(F.transform("values", lambda v: F.when(v.isNull(), "-").otherwise(F.format_string("%.1f", v))), "|")
    return out.select("l_orderkey", "l_linenumber", F.col("place").cast("int").alias("place"), "field_id", "label", numbers.alias("numbers"))


@query("text_blocks", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS a FROM events),
n AS (SELECT *, sum(CASE WHEN a = '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM e)
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY k) - 1 AS block FROM n WHERE a <> ''""")
def text_blocks(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).otherwise("").alias("a"))
    return tables.blocks(rows, ["user_id"], "event_id", ["a"]).select("user_id", "event_id", F.col("block").cast("long").alias("block"))


@query("wide_page", WITH_ORDERS + "SELECT entity, year, total, round(total_f / nullif(total, 0), 4) AS share FROM y WHERE entity IN ('NATION_1', 'NATION_2') AND year IN (1995, 1996, 1997) ORDER BY entity, year LIMIT 4")
def wide_page(spark, sf):
    return reads.wide_page(order_years(spark, sf), ["NATION_1", "NATION_2"], [1995, 1996, 1997], ["total"], {"share": ("total_f", ["total"])}, 1, 4)


@query("read_options", "SELECT 'o_orderstatus' AS kind, o_orderstatus AS value, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def read_options(spark, sf):
    return reads.options(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("similar_counts", "SELECT count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '2-HIGH') AS same_cell_series, count(*) FILTER (o_orderstatus = 'F') AS same_entity, count(*) FILTER (o_orderpriority = '2-HIGH') AS same_field FROM orders")
def similar_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("field_id"))
    return reads.similar_counts(rows, "F", "2-HIGH")


@query("method_inventory", "SELECT o_orderpriority AS field_id, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")
def method_inventory(spark, sf):
    return reads.inventory(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("field_id"), F.col("o_orderstatus").alias("method")), ["F", "O"])


@query("consistency_findings", WITH_ORDERS + """,
a AS (SELECT entity, year, field_id FROM c WHERE year <> 1995 UNION ALL SELECT 'NOWHERE', 1995, 'total')
SELECT 'final_without_audit' AS finding, 'high' AS severity, count(*) AS rows FROM c WHERE value IS NOT NULL AND year = 1995
UNION ALL SELECT 'audit_without_final', 'medium', 1 UNION ALL SELECT 'duplicate_keys', 'high', 0
UNION ALL SELECT 'wide_differs_from_long', 'high', count(*) FROM c WHERE value IS NOT NULL AND field_id = 'total_p' AND year = 1996""")
def consistency_findings(spark, sf):
    final = cells(spark, sf)
    extra = spark.createDataFrame([("NOWHERE", 1995, "total")], "entity string, year int, field_id string")
    audited = final.where("year <> 1995").select(*CELL).unionByName(extra)
    shown = final.withColumn("value", F.when((F.col("field_id") == "total_p") & (F.col("year") == 1996), F.col("value") + 1).otherwise(F.col("value")))
    return reads.findings(final, audited, shown)


@query("table_status", "SELECT 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def table_status(spark, sf):
    return reads.status({n: table(spark, sf, n) for n in ("orders", "customer")})


@query("golden_frozen", WITH_ORDERS + """
SELECT entity, year, total * (CASE WHEN year >= 1996 THEN 2 WHEN year >= 1995 THEN 1 ELSE 0.5 END) AS value, CASE WHEN year >= 1996 THEN 'human' WHEN year >= 1995 THEN 'auto_confirmed' ELSE 'manual' END AS origin FROM y WHERE entity <> 'NATION_5'""")
def golden_frozen(spark, sf):
    y = order_years(spark, sf).select("entity", "year", F.col("total").alias("value"))
    scaled = lambda df, k, origin: df.withColumn("value", F.col("value") * k).withColumn("origin", F.lit(origin))
    return audit.freeze_golden(scaled(y, 0.5, "manual"), scaled(y.where("year >= 1995"), 1.0, "auto_confirmed"), scaled(y.where("year >= 1996"), 2.0, "human"), y.where("entity = 'NATION_5'"), ["entity", "year"])

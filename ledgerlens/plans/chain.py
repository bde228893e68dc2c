"""Queries that run the operators of the extraction chain, evidence, reads and schedules that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, mapping, marts, matching, reads, review, schedule, tables
from ..operators.actions import CELL
from ..sources import sinks
from .actions import ROWS, first_rows, rows
from .base import query, table
from .parsing import said

#: Facts: line items; the words of the part's type are its label, the last one its element; returned ones are text blocks.
FACTS = """
WITH f AS (SELECT l_orderkey AS doc, split_part(p_type, ' ', 2) AS local_name, p_type || ' 売上' || (l_linenumber % 3) AS label, l_returnflag = 'R' AS is_text, CAST(l_quantity AS VARCHAR) AS value, l_partkey * 10000 + CAST(floor(l_extendedprice) AS BIGINT) % 10000 AS ord FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (
  SELECT *, 'a' AS field_id, 0 AS priority FROM f WHERE lower(local_name) = 'anodized' UNION ALL SELECT *, 'a', 1 FROM f WHERE contains(label, '売上1')
  UNION ALL SELECT *, 'b', 0 FROM f WHERE contains(label, '売上2') UNION ALL SELECT *, 'b', 1 FROM f WHERE lower(local_name) = 'brushed' UNION ALL SELECT *, 'b', 2 FROM f WHERE lower(local_name) = 'plated'),
p AS (SELECT * FROM m QUALIFY is_text = (min(is_text::INT) OVER (PARTITION BY doc, field_id))::BOOL),
b AS (SELECT * FROM p QUALIFY priority = min(priority) OVER (PARTITION BY doc, field_id)),
c AS (SELECT doc, field_id, arg_min(value, ord) AS value, arg_min(priority, ord) AS priority, count(DISTINCT value) AS candidates FROM b GROUP BY 1, 2)"""
FIELDS = {"a": ["Anodized", "売上1"], "b": ["売上2", "brushed", "PLATED"]}


def chain(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    l = table(spark, sf, "lineitem").join(p, "l_partkey")  # noqa: E741
    name = F.split_part("p_type", F.lit(" "), F.lit(2))
    label = F.concat("p_type", F.lit(" 売上"), (F.col("l_linenumber") % 3).cast("string"))
    order = F.col("l_partkey") * 10000 + F.floor("l_extendedprice") % 10000
    facts = l.select(F.col("l_orderkey").alias("doc"), name.alias("local_name"), label.alias("label"), (F.col("l_returnflag") == "R").alias("is_text"), F.col("l_quantity").cast("string").alias("value"), order.alias("ord"))
    return matching.candidates(facts, FIELDS, ["doc"])


@query("fact_candidates", FACTS + " SELECT doc, field_id, priority, candidates FROM c")
def fact_candidates(spark, sf):
    return chain(spark, sf).select("doc", "field_id", "priority", "candidates")


@query("always_emitted_grid", FACTS + " SELECT o_orderkey AS doc, x.field_id, CASE WHEN c.value IS NULL THEN 'not_found' END AS reason, CASE WHEN c.value IS NULL THEN 0.0::DOUBLE WHEN candidates <= 1 THEN 0.95 ELSE 0.75 END AS confidence FROM orders CROSS JOIN (VALUES ('a'), ('b'), ('none')) x(field_id) LEFT JOIN c ON c.doc = o_orderkey AND c.field_id = x.field_id")
def always_emitted_grid(spark, sf):
    """A row for every order and field, found or not."""
    fields = spark.createDataFrame([("a",), ("b",), ("none",)], "field_id string")
    targets = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"))
    return matching.always(targets, fields, chain(spark, sf), ["doc"]).select("doc", "field_id", "reason", "confidence")


WHY = "CASE k % 5 WHEN 0 THEN 'confidence_below_threshold;review_required' WHEN 1 THEN 'review_required;validation_fail' WHEN 2 THEN 'unit_unknown;review_required' WHEN 3 THEN '' ELSE 'review_required' END"
RES = "CASE k % 4 WHEN 0 THEN 'auto_confirmed' WHEN 1 THEN 'conflicted' WHEN 2 THEN 'needs_review' ELSE 'single_source' END"


@query("evidence_demotion", ROWS + f""",
w AS (SELECT k, [x FOR x IN string_split({WHY}, ';') IF x <> ''] AS why, {RES} AS res FROM q)
SELECT k, array_to_string(CASE WHEN res = 'conflicted' THEN list_append(why, 'corroboration_conflict') WHEN res = 'needs_review' THEN list_append(why, 'corroboration_needs_review') WHEN res = 'auto_confirmed' AND NOT list_contains(why, 'validation_fail') THEN [x FOR x IN why IF x NOT IN ('confidence_below_threshold', 'review_required')] ELSE why END, ';') AS why FROM w""")
def evidence_demotion(spark, sf):
    why = F.filter(F.split(F.expr(WHY), ";"), lambda x: x != "")
    return first_rows(spark, sf).select("k", F.array_join(review.demote(why, F.expr(RES)), ";").alias("why"))


@query("rule_evidence", ROWS + " SELECT entity, year, field_id, k % 3 = 0 AS matched, count(*) AS n FROM (SELECT entity, year, unnest([field_id, 'total']) AS field_id, k FROM q WHERE k % 3 < 2) GROUP BY 1, 2, 3, 4")
def rule_evidence(spark, sf):
    """A pass is a match, a fail a conflict, anything else no evidence, for each field that a rule names."""
    status = F.when(F.col("k") % 3 == 0, "pass").when(F.col("k") % 3 == 1, "fail").otherwise("not_applicable")
    results = first_rows(spark, sf).select("entity", "year", F.lit("sum").alias("rule_id"), status.alias("status"), F.array("field_id", F.lit("total")).alias("field_ids"))
    return evidence.from_rules(results).groupBy(*CELL, "matched").agg(F.count("*").alias("n"))


@query("external_evidence", ROWS + """
SELECT q.entity, q.year, q.field_id, abs(q.price - r.price) <= greatest(1.0, greatest(abs(q.price), abs(r.price), 1.0) * 0.001) AS matched, count(*) AS n FROM q JOIN r ON q.entity = r.entity AND q.year = r.year AND q.field_id = r.field_id WHERE r.field_id IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3, 4""")
def external_evidence(spark, sf):
    """All orders of a cell against its first one, through a map of categories to fields."""
    cells = first_rows(spark, sf).select(*CELL, F.col("price").alias("value"))
    mart = rows(spark, sf).select("entity", "year", F.left("field_id", F.lit(1)).alias("category"), F.col("price").alias("value"))
    fields = spark.createDataFrame([("1", "1-URGENT"), ("2", "2-HIGH")], "category string, field_id string")
    return evidence.external(cells, mart, fields).groupBy(*CELL, "matched").agg(F.count("*").alias("n"))


@query("document_digests", "SELECT l_orderkey, count(*) AS facts, count(*) FILTER (l_returnflag = 'A') AS numeric, count(*) FILTER (l_returnflag = 'R') AS texts, count(*) FILTER (l_linestatus = 'O') AS standalone FROM lineitem GROUP BY 1")
def document_digests(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "numeric").when(F.col("l_returnflag") == "R", "text").otherwise("string")
    facts = table(spark, sf, "lineitem").select("l_orderkey", kind.alias("value_type"), F.when(F.col("l_linestatus") == "O", "standalone").otherwise("consolidated").alias("normalized_scope"))
    return marts.digest(facts, ["l_orderkey"])


@query("local_rows_split", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') END, false) AS accepted FROM orders")
def local_rows_split(spark, sf):
    """Rows that pass and are of listed fields are accepted; an unknown answer is for manual work."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    ok = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    accepted, manual = marts.split_rows(o, ok)
    return accepted.select("o_orderkey", F.lit(True).alias("accepted")).unionByName(manual.select("o_orderkey", F.lit(False).alias("accepted")))


@query("batch_chunks", "SELECT c_custkey, CAST(floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) / 10) AS BIGINT) AS chunk FROM customer")
def batch_chunks(spark, sf):
    return mapping.chunks(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], ["c_custkey"], 10).select("c_custkey", "chunk")


@query("first_value_per_cell", ROWS + " SELECT entity, year, field_id, k FROM r QUALIFY row_number() OVER (PARTITION BY entity, year, field_id ORDER BY price DESC, k) = 1")
def first_value_per_cell(spark, sf):
    return tables.first_per_cell(rows(spark, sf), CELL, "price", "k").select(*CELL, "k")


@query("review_queue_page", ROWS + """,
n AS (SELECT q.*, CASE WHEN s.k IS NOT NULL THEN 'accept' END AS saved, CASE WHEN state = 'F' THEN 'missing' ELSE 'new_candidate' END AS category FROM q LEFT JOIN (SELECT k FROM q WHERE k % 2 = 0) s USING (k))
SELECT entity, year, field_id, saved IS NOT NULL AS review_saved, CASE WHEN saved IS NOT NULL THEN 'x' ELSE CAST(k AS VARCHAR) END AS shown_value FROM n WHERE category = 'missing' ORDER BY entity, year, field_id LIMIT 25 OFFSET 25""")
def review_queue_page(spark, sf):
    q = first_rows(spark, sf)
    queue = q.select(*CELL, F.col("k").cast("string").alias("value"), F.when(F.col("state") == "F", "missing").otherwise("new_candidate").alias("category"))
    saved = q.where("k % 2 = 0").select(*CELL, F.lit("accept").alias("decision"), F.lit("x").alias("corrected_value"))
    one, _ = reads.queue_page(reads.queue_with_saved(queue, saved, CELL), "missing", CELL, 2, 25)
    return one.select(*CELL, "review_saved", "shown_value")


@query("review_queue_facets", ROWS + " SELECT CASE WHEN state = 'F' THEN 'missing' ELSE 'new_candidate' END AS category, count(*) AS rows FROM q GROUP BY 1")
def review_queue_facets(spark, sf):
    queue = first_rows(spark, sf).select(*CELL, F.when(F.col("state") == "F", "missing").otherwise("new_candidate").alias("category"))
    return reads.queue_page(queue, "missing", CELL, 1, 25)[1]


@query("cell_detail", ROWS + """,
o AS (SELECT * FROM q ORDER BY k LIMIT 1)
SELECT o.entity, o.year, o.field_id, o.price AS value, (SELECT count(*) FROM r WHERE r.entity = o.entity AND r.year = o.year AND r.field_id = o.field_id AND state <> 'O') AS audits, (SELECT string_agg(k, ',' ORDER BY k) FROM r WHERE r.entity = o.entity AND r.year = o.year AND r.field_id = o.field_id) AS evidence FROM o""")
def cell_detail(spark, sf):
    """All that is known of the cell of the first order."""
    r = rows(spark, sf)
    at = r.orderBy("k").select(*CELL).head()
    ks = r.select(*CELL, "k")
    out = reads.cell_detail(first_rows(spark, sf).select(*CELL, F.col("price").alias("value")), r.where("state <> 'O'").select(*CELL, "k"), ks, ks.where("false"), at["entity"], at["year"], at["field_id"])
    key = F.col("entity").cast("long").alias("entity")
    return out.select(key, "year", "field_id", "value", F.size("audit").cast("long").alias("audits"), F.array_join(F.transform("evidence", lambda x: x["k"].cast("string")), ",").alias("evidence"))


BREAK = "CASE o_orderkey % 3 WHEN 0 THEN '100 200 300' WHEN 1 THEN '100 200 400' ELSE '5 6' END"


@query("breakdowns_that_add_up", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 300.0::DOUBLE END AS total FROM orders")
def breakdowns_that_add_up(spark, sf):
    values = F.transform(F.split(F.expr(BREAK), " "), lambda x: x.cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", tables.breakdown(values, 2)["total"].alias("total"))


COST = "CASE o_orderkey % 4 WHEN 0 THEN '材料費 1,000 20.5 ' || CAST(o_custkey AS STRING) || ' 19.1' WHEN 1 THEN '労務費 5 材料費　' || CAST(o_custkey AS STRING) WHEN 2 THEN '材料費 △300 １，２００' ELSE '経費 7' END"


@query("cost_values", "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN 1200 END AS DOUBLE) AS value FROM orders")
def cost_values(spark, sf):
    """The current amount behind a label: of pairs with ratios the second, of two amounts the second, of one that."""
    return said(spark, sf, f"{COST} AS t").select("o_orderkey", tables.cost_value(F.col("t"), "材料費").alias("value"))


NOISE = """CASE o_orderkey % 5 WHEN 0 THEN '{"a": ' || CAST(o_custkey AS STRING) || '}' WHEN 1 THEN 'see: ```json' || chr(10) || '{"a": 1}' || chr(10) || '``` done' WHEN 2 THEN 'so [1, 2] it is' WHEN 3 THEN 'no json {here' ELSE '' END"""


@query("json_in_noise", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '{\"a\": ' || o_custkey || '}' WHEN 1 THEN chr(10) || '{\"a\": 1}' || chr(10) WHEN 2 THEN '[1, 2]' END AS found FROM orders")
def json_in_noise(spark, sf):
    got = said(spark, sf, f"{NOISE} AS t").select("o_orderkey", tables.json_in(F.col("t")).alias("found"))
    fenced = F.col("o_orderkey") % 5 == 1
    return got.withColumn("found", F.when(fenced, F.concat(F.lit("\n"), F.btrim("found", F.lit(" \n")), F.lit("\n"))).otherwise(F.col("found")))


@query("days_and_staleness", "SELECT o_orderkey, (date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-06-30') > 400) AS stale, CASE WHEN o_orderdate < DATE '1992-01-20' THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1992-01-20') AS INTEGER) + 1 ELSE 0 END AS days FROM orders")
def days_and_staleness(spark, sf):
    day, end = F.to_date("o_orderdate"), F.lit("1992-01-20").cast("date")
    days = F.when(day < end, F.size(schedule.day_range(day, end))).otherwise(0)
    return table(spark, sf, "orders").select("o_orderkey", schedule.staleness(day, F.lit("1996-06-30").cast("date"), 400).alias("stale"), days.alias("days"))


@query("errors_by_listing", "SELECT c_custkey AS security, CASE WHEN c_custkey % 4 = 0 THEN true WHEN c_custkey % 4 = 1 THEN DATE '1995-01-01' >= DATE '1994-01-01' ELSE false END AS active FROM customer")
def errors_by_listing(spark, sf):
    """Errors of securities: one in four is unknown or listed, the others not yet or no more."""
    k = F.col("c_custkey")
    date = lambda d: F.lit(d).cast("date")
    c = table(spark, sf, "customer")
    known = c.where("c_custkey % 4 <> 0").select(k.alias("security"), F.when(k % 4 == 2, date("1996-01-01")).alias("listed_from"), F.when(k % 4 == 3, date("1993-01-01")).otherwise(date("1999-01-01")).alias("listed_to"))
    return schedule.split_errors(c.select(k.alias("security")), known, date("1995-01-01"))


@query("next_filing_window", "SELECT 'winter' AS name, '1994-12-20' AS window_start")
def next_filing_window(spark, sf):
    """The next window after the first of September 1994, of windows around that day."""
    windows = spark.createDataFrame([("spring", 6, 1, 8, 15), ("winter", 12, 20, 2, 10)], "name string, start_month int, start_day int, end_month int, end_day int")
    today = F.lit("1994-09-01").cast("date")
    out = schedule.next_window(schedule.filing_windows(windows, today), today)
    return out.select("name", F.col("window_start").cast("string").alias("window_start"))


@query("payload_rows", "SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS row_json FROM customer")
def payload_rows(spark, sf):
    """Typed key columns with the whole row as JSON, keys in order."""
    return sinks.with_payload(table(spark, sf, "customer").select("c_name", "c_custkey"), ["c_custkey"])


@query("rows_under_all_columns", "SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def rows_under_all_columns(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sinks.union_all([a, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))])

"""Queries on cells: pivots, ratios, rules, evidence, resolution, review, coverage and golden values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import audit, evidence, market, matching, merge, reshape, review, rules
from .base import WITH_ITEMS, WITH_ORDERS, item_years, order_years, orders_by_nation, query, table

FIELDS = ["total", "total_f", "total_o", "total_p"]
CELL = ["entity", "year", "field_id"]


def cells(spark, sf):
    return reshape.unpivot(order_years(spark, sf), ["entity", "year"], FIELDS)


@query("analysis_wide", WITH_ORDERS + """
SELECT entity, year, orders, total, total_f, total_o, total_p, round(total_f / nullif(total, 0), 4) AS filled_share, round(total_o / nullif(total, 0), 4) AS open_share,
  lead(total) OVER w AS next_total, round((lead(total) OVER w - total) / nullif(total, 0), 4) AS total_growth
FROM y WINDOW w AS (PARTITION BY entity ORDER BY year)""")
def analysis_wide(spark, sf):
    """Wide entity and year table with ratios, the next year's value and growth."""
    wide = reshape.with_ratios(order_years(spark, sf), {"filled_share": ("total_f", ["total"]), "open_share": ("total_o", ["total"])})
    return reshape.with_lead(wide, "total", ["entity"], "year")


@query("fiscal_year_totals", WITH_ORDERS + "SELECT entity, year, orders, total FROM y")
def fiscal_year_totals(spark, sf):
    return order_years(spark, sf).select("entity", "year", "orders", "total")


@query("unpivot_cells", WITH_ORDERS + "SELECT * FROM c")
def unpivot_cells(spark, sf):
    return cells(spark, sf)


#: Several rows a cell: each order status is a method, the priority is the review state.
PIVOT_SQL = WITH_ORDERS + """,
r AS (
  SELECT entity, year, o_orderpriority AS field_id, o_totalprice AS value, o_orderkey AS ordinal, o_orderstatus AS method,
    CASE WHEN o_orderkey % 7 = 0 THEN 'corrected' WHEN o_orderkey % 3 = 0 THEN 'approved' ELSE 'unreviewed' END AS status FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, year, field_id ORDER BY CASE status WHEN 'corrected' THEN 4 WHEN 'approved' THEN 3 WHEN 'auto_accepted' THEN 2 ELSE 1 END DESC, CASE WHEN method = 'F' THEN 1 ELSE 0 END DESC, ordinal DESC) AS k FROM r)
SELECT entity, year, max(CASE WHEN field_id = '1-URGENT' THEN value END) AS urgent, max(CASE WHEN field_id = '2-HIGH' THEN value END) AS high, max(CASE WHEN field_id = '3-MEDIUM' THEN value END) AS medium
FROM b WHERE k = 1 GROUP BY 1, 2"""


def long_rows(spark, sf):
    state = F.when(F.col("o_orderkey") % 7 == 0, "corrected").when(F.col("o_orderkey") % 3 == 0, "approved").otherwise("unreviewed")
    return orders_by_nation(spark, sf).select("entity", "year", F.col("o_orderpriority").alias("field_id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderstatus").alias("method"), state.alias("status"))


@query("priority_pivot_wide", PIVOT_SQL)
def priority_pivot_wide(spark, sf):
    out = reshape.priority_pivot(long_rows(spark, sf), ["1-URGENT", "2-HIGH", "3-MEDIUM"], "F")
    return out.select("entity", "year", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("3-MEDIUM").alias("medium"))


@query("best_row_per_cell", PIVOT_SQL[: PIVOT_SQL.rindex("SELECT entity, year, max(")] + "SELECT entity, year, field_id, value, ordinal, method, status FROM b WHERE k = 1")
def best_row_per_cell(spark, sf):
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in reshape.STATUS_RANK.items() for x in kv]), "status"), F.lit(0))
    return reshape.best_row(long_rows(spark, sf), CELL, [rank, (F.col("method") == "F").cast("int")], "ordinal")


@query("derived_ratios", WITH_ITEMS + """
SELECT i.entity, i.year, round(gross / nullif(price, 0), 4) AS gross_rate, round(price / nullif(quantity, 0), 4) AS unit_price, round(total_f / nullif(total_f + total_o + total_p, 0), 4) AS filled_rate
FROM i JOIN y USING (entity, year)""")
def derived_ratios(spark, sf):
    both = item_years(spark, sf).join(order_years(spark, sf), ["entity", "year"])
    out = reshape.with_ratios(both, {"gross_rate": ("gross", ["price"]), "unit_price": ("price", ["quantity"]), "filled_rate": ("total_f", ["total_f", "total_o", "total_p"])})
    return out.select("entity", "year", "gross_rate", "unit_price", "filled_rate")


@query("yoy_anomaly", WITH_ORDERS + """,
x AS (SELECT entity, year, field_id, value, lag(value) OVER (PARTITION BY entity, field_id ORDER BY year) AS before FROM c WHERE field_id IN ('total', 'total_f'))
SELECT entity, year, field_id, round(value / nullif(before, 0) - 1, 4) AS change,
  CASE WHEN value IS NULL OR before IS NULL OR before = 0 THEN 'not_applicable' WHEN abs(value / before - 1) > 0.5 THEN 'warn' ELSE 'pass' END AS status FROM x""")
def yoy_anomaly(spark, sf):
    out = rules.validate(cells(spark, sf), [rules.ChangeRule("yoy", ("total", "total_f"))])
    return out.select("entity", "year", F.get("field_ids", F.lit(0)).alias("field_id"), F.round("difference", 4).alias("change"), "status")


@query("yoy_signed_base", WITH_ORDERS + """,
b AS (SELECT entity, year, total_f - total_o AS value FROM y),
x AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY year) AS before FROM b)
SELECT entity, year, round(value / nullif(before, 0) - 1, 4) AS change,
  CASE WHEN value IS NULL OR before IS NULL OR before = 0 THEN 'not_applicable' WHEN abs(value / before - 1) > 0.5 THEN 'warn' ELSE 'pass' END AS status FROM x""")
def yoy_signed_base(spark, sf):
    """The same over a balance that is often negative: the change is value / before - 1, whatever the sign of the base."""
    balance = order_years(spark, sf).select("entity", "year", F.lit("balance").alias("field_id"), (F.col("total_f") - F.col("total_o")).alias("value"))
    out = rules.validate(balance, [rules.ChangeRule("yoy", ("balance",))])
    return out.select("entity", "year", F.round("difference", 4).alias("change"), "status")


@query("rule_missing_fields", WITH_ORDERS + """
SELECT entity, year, array_to_string([x FOR x IN [CASE WHEN total_f IS NULL THEN 'total_f' END, CASE WHEN total_o IS NULL THEN 'total_o' END, CASE WHEN total_p IS NULL THEN 'total_p' END] IF x IS NOT NULL], ',') AS missing,
  CASE WHEN total_f IS NULL OR total_o IS NULL OR total_p IS NULL THEN 'not_applicable' WHEN abs(total - total_f - total_o - total_p) <= greatest(10.0, abs(total) * 0.01) THEN 'pass' ELSE 'fail' END AS status FROM y""")
def rule_missing_fields(spark, sf):
    out = rules.validate(cells(spark, sf), [rules.SumRule("sum", "total", ("total_f", "total_o", "total_p"))])
    return out.select("entity", "year", F.array_join("missing", ",").alias("missing"), "status")


SUM_SQL = WITH_ORDERS + """,
s AS (SELECT entity, year, 'sum' AS rule_id, CASE WHEN total IS NULL OR total_f IS NULL OR total_o IS NULL OR total_p IS NULL THEN 'not_applicable'
    WHEN abs(total - (total_f + total_o + total_p)) <= greatest(10.0, abs(total) * 0.01) THEN 'pass' ELSE 'fail' END AS status, round(total - (total_f + total_o + total_p), 2) + 0.0 AS difference FROM y)
"""


@query("sum_identity", SUM_SQL + "SELECT * FROM s")
def sum_identity(spark, sf):
    out = rules.validate(cells(spark, sf), [rules.SumRule("sum", "total", ("total_f", "total_o", "total_p"))])
    return out.select("entity", "year", "rule_id", "status", (F.round("difference", 2) + 0.0).alias("difference"))


@query("upper_bound", WITH_ORDERS + """,
b AS (SELECT entity, year, field_id, value, total_f AS bound FROM c JOIN y USING (entity, year) WHERE field_id IN ('total_o', 'total_p'))
SELECT entity, year, field_id, CASE WHEN value IS NULL OR bound IS NULL THEN 'not_applicable' WHEN value <= bound THEN 'pass' ELSE 'fail' END AS status FROM b""")
def upper_bound(spark, sf):
    out = rules.validate(cells(spark, sf), [rules.BoundRule("bound", ("total_o", "total_p"), "total_f")])
    return out.select("entity", "year", F.get("field_ids", F.lit(0)).alias("field_id"), "status")


@query("rollforward_identity", WITH_ORDERS + """,
x AS (SELECT *, lag(total) OVER (PARTITION BY entity ORDER BY year) AS before FROM y)
SELECT entity, year, round(before + total_f - total_o - total, 2) AS difference,
  CASE WHEN before + total_f - total_o - total IS NULL THEN 'not_applicable' WHEN abs(before + total_f - total_o - total) <= greatest(50.0, abs(total) * 0.03) THEN 'pass' ELSE 'fail' END AS status FROM x""")
def rollforward_identity(spark, sf):
    out = rules.validate(cells(spark, sf), [rules.RollRule("roll", "total", "total_f", "total_o")])
    return out.select("entity", "year", F.round("difference", 2).alias("difference"), "status")


RULES = [rules.SumRule("sum", "total", ("total_f", "total_o", "total_p")), rules.BoundRule("bound", ("total_o",), "total_f"), rules.ChangeRule("yoy", ("total",))]


@query("attach_worst_status", SUM_SQL.rstrip() + """,
r AS (
  SELECT entity, year, unnest(['total', 'total_f', 'total_o', 'total_p']) AS field_id, status FROM s
  UNION ALL SELECT entity, year, unnest(['total_o', 'total_f']), CASE WHEN total_o IS NULL OR total_f IS NULL THEN 'not_applicable' WHEN total_o <= total_f THEN 'pass' ELSE 'fail' END FROM y
  UNION ALL SELECT entity, year, 'total', CASE WHEN b IS NULL OR b = 0 THEN 'not_applicable' WHEN abs((total - b) / abs(b)) > 0.5 THEN 'warn' ELSE 'pass' END FROM (SELECT *, lag(total) OVER (PARTITION BY entity ORDER BY year) AS b FROM y)),
w AS (SELECT entity, year, field_id, max(CASE status WHEN 'fail' THEN 3 WHEN 'warn' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) AS k FROM r GROUP BY 1, 2, 3)
SELECT c.entity, c.year, c.field_id, value, CASE k WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' WHEN 1 THEN 'pass' ELSE 'not_applicable' END AS validation_status,
  CASE k WHEN 3 THEN 'validation_fail' WHEN 2 THEN 'validation_warn' END AS validation_reason
FROM c LEFT JOIN w USING (entity, year, field_id)""")
def attach_worst_status(spark, sf):
    own = cells(spark, sf)
    return rules.attach_worst(own, rules.validate(own, RULES))


def methods(spark, sf):
    """total by three methods: from orders, from line items, and from finished orders only."""
    o = order_years(spark, sf)
    one = lambda df, m, v: df.select("entity", "year", F.lit("total").alias("field_id"), F.lit(m).alias("method"), F.lit("usd").alias("unit"), F.col(v).alias("value"))
    return one(o, "XBRL_CSV", "total").unionByName(one(item_years(spark, sf), "LOCAL_TABLE", "gross")).unionByName(one(o, "MANUAL", "total_f"))


EVIDENCE_SQL = WITH_ITEMS + """,
m AS (
  SELECT entity, year, 'XBRL_CSV' AS method, total AS value FROM y UNION ALL SELECT entity, year, 'LOCAL_TABLE', gross FROM i UNION ALL SELECT entity, year, 'MANUAL', total_f FROM y),
e AS (
  SELECT a.entity, a.year, 'xbrl_vs_local' AS check_kind, a.method || '|' || b.method AS check_ref, abs(a.value - b.value) <= greatest(1.0, greatest(abs(a.value), abs(b.value), 1.0) * 0.001) AS matched,
    a.value AS primary_value, b.value AS other_value, false AS restated, a.method AS method_a, b.method AS method_b
  FROM m a JOIN m b ON a.entity = b.entity AND a.year = b.year AND a.method < b.method WHERE a.value IS NOT NULL AND b.value IS NOT NULL
  UNION ALL
  SELECT y.entity, y.year, 'next_year_prior', CAST(y.year + 1 AS VARCHAR), abs(y.total - p.prior) <= greatest(1.0, greatest(abs(y.total), abs(p.prior), 1.0) * 0.001),
    y.total, p.prior, abs(y.total - p.prior) > greatest(1.0, greatest(abs(y.total), abs(p.prior), 1.0) * 0.001), NULL, NULL
  FROM y JOIN (SELECT entity, year - 1 AS year, lag(total) OVER (PARTITION BY entity ORDER BY year) AS prior FROM y) p ON y.entity = p.entity AND y.year = p.year WHERE p.prior IS NOT NULL)
"""


def all_evidence(spark, sf):
    from pyspark.sql.window import Window

    o = order_years(spark, sf).withColumn("field_id", F.lit("total")).select(*CELL, F.col("total").alias("value"))
    prior = o.withColumn("value", F.lag("value").over(Window.partitionBy("entity").orderBy("year")))
    return evidence.same_cell(methods(spark, sf)).unionByName(evidence.next_year_prior(o, prior))


@query("same_cell_pairs", EVIDENCE_SQL + "SELECT entity, year, check_ref, matched, round(primary_value - other_value, 2) AS difference FROM e WHERE check_kind = 'xbrl_vs_local'")
def same_cell_pairs(spark, sf):
    return evidence.same_cell(methods(spark, sf)).select("entity", "year", "check_ref", "matched", F.round("difference", 2).alias("difference"))


@query("next_year_prior", EVIDENCE_SQL + "SELECT entity, year, check_ref, matched, restated AS restatement_suspected, round(primary_value - other_value, 2) AS difference FROM e WHERE check_kind = 'next_year_prior'")
def next_year_prior(spark, sf):
    return all_evidence(spark, sf).where("check_kind = 'next_year_prior'").select("entity", "year", "check_ref", "matched", "restatement_suspected", F.round("difference", 2).alias("difference"))


@query("evidence_summary", EVIDENCE_SQL + """
SELECT y.entity, y.year, 'total' AS field_id, count(*) FILTER (matched) AS corroboration_count, count(*) FILTER (NOT matched AND NOT restated) AS conflict_count, count(*) FILTER (restated) AS restatement_count
FROM y LEFT JOIN e USING (entity, year) GROUP BY 1, 2""")
def evidence_summary(spark, sf):
    own = order_years(spark, sf).withColumn("field_id", F.lit("total"))
    return evidence.summarize(own, all_evidence(spark, sf))


@query("resolution_ladder", EVIDENCE_SQL + """,
k AS (
  SELECT y.entity, y.year, y.total, count(*) FILTER (NOT matched AND NOT restated) AS conflicts, count(*) FILTER (matched) AS matches,
    bool_or(matched AND (method_a = 'XBRL_CSV' OR method_b = 'XBRL_CSV')) AS x, bool_or(matched AND (method_a = 'LOCAL_TABLE' OR method_b = 'LOCAL_TABLE')) AS l,
    bool_or(matched AND (method_a = 'MANUAL' OR method_b = 'MANUAL')) AS m, bool_or(matched AND check_kind = 'next_year_prior' AND abs(total - primary_value) <= greatest(1.0, abs(total) * 0.005)) AS n
  FROM y LEFT JOIN e USING (entity, year) GROUP BY 1, 2, 3),
q AS (SELECT *, coalesce(x, false)::INT + coalesce(l, false)::INT + coalesce(m, false)::INT + coalesce(n, false)::INT AS buckets FROM k)
SELECT entity, year, CAST(buckets AS INTEGER) AS independent_buckets,
  CASE WHEN total IS NULL THEN 'no_value' WHEN conflicts > 0 THEN 'conflicted' WHEN buckets >= 2 THEN 'auto_confirmed' WHEN buckets = 1 THEN 'single_source' ELSE 'needs_review' END AS resolution,
  CASE WHEN total IS NULL THEN '' WHEN conflicts > 0 THEN 'value_disagreement' WHEN buckets >= 2 THEN '' WHEN buckets = 1 THEN 'single_source_only' ELSE 'insufficient_corroboration' END AS resolution_reason
FROM q""")
def resolution_ladder(spark, sf):
    own = order_years(spark, sf).select("entity", "year", F.lit("total").alias("field_id"), F.col("total").alias("value"), F.lit("XBRL_CSV").alias("method"), F.lit("pass").alias("validation_status"))
    # Sources of finished orders alone disagree by design; half of the entities have none.
    return evidence.resolve(own, all_evidence(spark, sf)).select("entity", "year", "independent_buckets", "resolution", "resolution_reason")


@query("external_mart_compare", WITH_ITEMS + """
SELECT i.entity, i.year, gross AS value, total AS reference, round(gross - total, 2) AS difference,
  CASE WHEN total IS NULL THEN 'no_reference' WHEN gross IS NULL THEN 'no_value' WHEN abs(gross - total) <= 100 OR abs(gross - total) <= abs(total) * 0.005 THEN 'pass' ELSE 'mismatch' END AS status
FROM i LEFT JOIN y USING (entity, year)""")
def external_mart_compare(spark, sf):
    mart = item_years(spark, sf).select("entity", "year", F.col("gross").alias("value"))
    out = market.compare_mart(mart, order_years(spark, sf), ["entity", "year"], "value", "total")
    return out.withColumn("difference", F.round("difference", 2))


@query("group_sum_compare", WITH_ORDERS + """,
g AS (SELECT entity, year, round(sum(value), 2) AS group_total FROM c WHERE field_id <> 'total' GROUP BY 1, 2 HAVING count(*) FILTER (value IS NULL) = 0)
SELECT entity, year, group_total, total AS reference, CASE WHEN abs(group_total - total) <= 100 OR abs(group_total - total) <= abs(total) * 0.005 THEN 'pass' ELSE 'mismatch' END AS status FROM g LEFT JOIN y USING (entity, year)""")
def group_sum_compare(spark, sf):
    parts = cells(spark, sf).where("field_id <> 'total'")
    out = market.group_sums(parts, ["entity", "year"], "value", order_years(spark, sf), "total")
    return out.select("entity", "year", F.round("group_total", 2).alias("group_total"), "reference", "status")


@query("mart_overall_status", WITH_ITEMS + """,
s AS (SELECT CASE WHEN total IS NULL OR gross IS NULL THEN 'no' WHEN abs(gross - total) <= 100 OR abs(gross - total) <= abs(total) * 0.005 THEN 'pass' ELSE 'mismatch' END AS st FROM i LEFT JOIN y USING (entity, year)),
n AS (SELECT count(*) AS rows, count(*) FILTER (st = 'pass') AS passed, count(*) FILTER (st = 'mismatch') AS mismatched FROM s)
SELECT *, rows - passed - mismatched AS pending, CASE WHEN mismatched > 0 THEN 'mismatch' WHEN rows > passed + mismatched THEN 'incomplete' ELSE 'completed' END AS overall FROM n""")
def mart_overall_status(spark, sf):
    return market.overall(external_mart_compare(spark, sf))


@query("effective_document", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def effective_document(spark, sf):
    docs = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    order = [(F.col("o_orderpriority") == "1-URGENT").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return matching.effective(docs, ["o_custkey"], order).drop("o_orderpriority")


FACTS_SQL = """
WITH f AS (SELECT l_orderkey AS doc, p_type AS label, split_part(p_type, ' ', 3) AS local_name, (l_returnflag = 'R') AS is_text, CAST(l_quantity AS VARCHAR) AS value, l_linenumber AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("candidate_guarded_filter", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, min(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS least FROM lineitem),
g AS (SELECT * FROM f WHERE (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 0 OR least = 1),
h AS (SELECT *, min(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM g)
SELECT l_orderkey, l_linenumber, l_quantity FROM h WHERE l_quantity = q""")
def candidate_guarded_filter(spark, sf):
    """Rows that are not returns where an order has such, all of its rows otherwise; of these the smallest quantities."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    kept = merge.prefer_if_any(items, ["l_orderkey"], F.col("l_returnflag") != "R")
    return merge.lowest_rank(kept, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query("full_outer_compare", """
WITH a AS (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey ELSE o_orderkey END AS k, round(o_totalprice, 2) AS v FROM orders),
b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value,
  CASE WHEN a.k IS NULL THEN 'new_only' WHEN b.k IS NULL THEN 'old_only' WHEN a.v IS NULL AND b.v IS NULL THEN 'both_blank' WHEN abs(a.v - b.v) <= 0.000001 THEN 'match' ELSE 'mismatch' END AS status
FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_compare(spark, sf):
    """Every order and line item: orders of the lowest priority have another key on the old side, so both sides have rows without a match."""
    key = F.when(F.col("o_orderpriority") == "5-LOW", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    a = table(spark, sf, "orders").select(key.alias("k"), F.round("o_totalprice", 2).alias("v"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    b = b.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("v"))
    return merge.full_compare(a, b, ["k"], "v")


def halves(spark, sf):
    base = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")
    return base.where("o_orderkey % 2 = 0"), base.where("o_orderkey % 2 = 1")


LAST = "SELECT o_custkey, o_orderstatus, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 2 = {}) WHERE k = 1"


@query("keyed_merge_last_wins", f"WITH a AS ({LAST.format(0)}), b AS ({LAST.format(1)}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus)")
def keyed_merge_last_wins(spark, sf):
    keys = ["o_custkey", "o_orderstatus"]
    a, b = (merge.last_wins(x, keys, "o_orderkey") for x in halves(spark, sf))
    return merge.merge(a, b, keys)


@query("protected_merge", f"WITH a AS ({LAST.format(0)}), b AS ({LAST.format(1)}) SELECT * FROM a WHERE o_totalprice > 100000 OR NOT EXISTS (SELECT 1 FROM b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus) UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = a.o_orderstatus AND a.o_totalprice > 100000)")
def protected_merge(spark, sf):
    keys = ["o_custkey", "o_orderstatus"]
    a, b = (merge.last_wins(x, keys, "o_orderkey") for x in halves(spark, sf))
    return merge.merge(a, b, keys, F.col("o_totalprice") > 100000)


@query("scoped_replace", f"""WITH a AS ({LAST.format(0)}), b0 AS ({LAST.format(1)}), b AS (SELECT * FROM b0 WHERE o_orderstatus = 'F')
SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderstatus <> 'F'""")
def scoped_replace(spark, sf):
    keys = ["o_custkey", "o_orderstatus"]
    a, b = (merge.last_wins(x, keys, "o_orderkey") for x in halves(spark, sf))
    new = b.where("o_orderstatus = 'F'")
    return merge.scoped_replace(a, new, spark.createDataFrame([("F",)], "o_orderstatus string"), ["o_orderstatus"], keys)


@query("keyed_delete", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def keyed_delete(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.delete(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), gone, ["o_orderkey"])


@query("suppress_blank_candidates", """
WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT * FROM e WHERE v IS NOT NULL OR NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.v IS NOT NULL)""")
def suppress_blank_candidates(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return merge.suppress_blanks(e, ["user_id", "event_type"], "v")


GOLDEN_SQL = WITH_ITEMS + """,
g AS (SELECT entity, year, total * (CASE WHEN year % 4 = 0 THEN 1.01 ELSE 1 END) AS value, CASE WHEN year % 2 = 0 THEN 'manual' ELSE 'human' END AS origin FROM y WHERE year <> 1995),
a AS (SELECT entity, year, CASE WHEN year = 1996 THEN NULL ELSE total END AS value FROM y),
d AS (SELECT entity, year, origin, CASE WHEN a.value IS NULL THEN CASE WHEN origin = 'manual' THEN 'missing_in_actual' ELSE 'human_locked_unreproduced' END
    WHEN abs(g.value - a.value) > greatest(1.0, abs(g.value) * 0.001) THEN CASE WHEN origin = 'manual' THEN 'value_mismatch' ELSE 'human_locked_unreproduced' END END AS kind FROM g LEFT JOIN a USING (entity, year)),
g2 AS (SELECT * FROM d WHERE kind IS NOT NULL UNION ALL SELECT entity, year, 'negative', 'negative_golden_violation' FROM a WHERE year = 1995 AND value IS NOT NULL)"""


@query("golden_diff", GOLDEN_SQL + " SELECT * FROM g2")
def golden_diff(spark, sf):
    return _golden(spark, sf).select("entity", "year", "origin", "kind")


def _golden(spark, sf):
    y = order_years(spark, sf).select("entity", "year", F.col("total").alias("value"))
    golden = y.where("year <> 1995").withColumn("value", F.col("value") * F.when(F.col("year") % 4 == 0, 1.01).otherwise(1.0)).withColumn("origin", F.when(F.col("year") % 2 == 0, "manual").otherwise("human"))
    actual = y.withColumn("value", F.when(F.col("year") != 1996, F.col("value")))
    return audit.golden_diff(golden, y.where("year = 1995"), actual, ["entity", "year"])


@query("golden_gate", GOLDEN_SQL + """ SELECT *, value_mismatch + missing_in_actual + negative_golden_violation = 0 AS passed FROM (
  SELECT count(*) FILTER (kind = 'value_mismatch') AS value_mismatch, count(*) FILTER (kind = 'missing_in_actual') AS missing_in_actual, count(*) FILTER (kind = 'negative_golden_violation') AS negative_golden_violation, count(*) FILTER (kind = 'human_locked_unreproduced') AS human_locked_unreproduced FROM g2)""")
def golden_gate(spark, sf):
    return audit.golden_summary(_golden(spark, sf))


@query("coverage_matrix", WITH_ORDERS + """,
fx AS (SELECT unnest(['total_f', 'total_o', 'total_p']) AS field_id), en AS (SELECT DISTINCT n_name AS entity FROM nation), yr AS (SELECT DISTINCT year FROM y),
g AS (SELECT * FROM en, yr, fx WHERE NOT (entity = 'NATION_3' AND field_id = 'total_p' AND year <= 1996)),
h AS (SELECT field_id, g.entity, year, value IS NOT NULL AS f FROM g LEFT JOIN c USING (entity, year, field_id))
SELECT field_id, entity, count(*) AS expected, count(*) FILTER (f) AS filled, count(*) FILTER (NOT f) AS blank, coalesce(string_agg(CASE WHEN NOT f THEN CAST(year AS VARCHAR) END, ',' ORDER BY year), '') AS blank_years, round(count(*) FILTER (f) / count(*), 4) AS rate
FROM h GROUP BY 1, 2""")
def coverage_matrix(spark, sf):
    years = order_years(spark, sf).agg(F.collect_set("year").alias("years"))
    names = table(spark, sf, "nation").select(F.col("n_name").alias("entity")).distinct()
    grid = names.join(F.broadcast(years)).select("entity", F.explode("years").alias("year"))  # one row of a few fiscal years
    exclusions = spark.createDataFrame([("NATION_3", "total_p", None, 1996)], "entity string, field_id string, from_year int, to_year int")
    filled = cells(spark, sf).where("value IS NOT NULL")
    out = audit.coverage_matrix(names, grid, FIELDS[1:], filled, exclusions)
    return out.withColumn("blank_years", F.array_join("blank_years", ","))


@query("exclusion_range_antijoin", """
WITH x(entity, field_id, a, b) AS (VALUES ('F', '1-URGENT', 1994, 1996), ('O', '2-HIGH', NULL, 1997), ('F', '5-LOW', NULL, NULL))
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM x WHERE entity = o_orderstatus AND field_id = o_orderpriority AND (a IS NULL OR year(o_orderdate) >= a) AND (b IS NULL OR year(o_orderdate) <= b))""")
def exclusion_range_antijoin(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("field_id"), F.year("o_orderdate").alias("year"))
    gone = spark.createDataFrame([("F", "1-URGENT", 1994, 1996), ("O", "2-HIGH", None, 1997), ("F", "5-LOW", None, None)], "entity string, field_id string, from_year int, to_year int")
    return matching.without_excluded(rows, gone).select("o_orderkey")


@query("set_differences", "SELECT o_custkey AS k, 'left_only' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT c_custkey, 'right_only' FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 EXCEPT SELECT o_custkey FROM orders)")
def set_differences(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


DECISION_SQL = "CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'correct' WHEN doc_id % 5 = 0 THEN 'not_applicable' ELSE 'accept' END"


def decisions(spark, sf):
    what = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "correct").when(F.col("doc_id") % 5 == 0, "not_applicable").otherwise("accept")
    return table(spark, sf, "labels").select("doc_id", what.alias("decision"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 10).alias("corrected_value"))


REVIEW_SQL = f"""
WITH r AS (SELECT CASE WHEN lang = 'fr' THEN -doc_id - 1 ELSE doc_id END AS doc_id, n_chars AS value, doc_id % 4 = 0 AS review_required FROM documents),
d AS (SELECT doc_id, {DECISION_SQL} AS decision, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 END AS corrected_value FROM labels),
j AS (SELECT coalesce(r.doc_id, d.doc_id) AS doc_id, r.doc_id IS NULL AS only_review, d.doc_id IS NULL AS only_row, value, review_required, decision, corrected_value FROM r FULL JOIN d ON r.doc_id = d.doc_id),
s AS (SELECT *, CASE WHEN decision = 'reject' THEN 'rejected' WHEN decision = 'not_applicable' THEN 'not_applicable' WHEN decision = 'correct' AND corrected_value IS NOT NULL THEN 'corrected' WHEN decision = 'accept' THEN 'approved' WHEN review_required THEN 'unreviewed' ELSE 'auto_accepted' END AS status,
  CASE WHEN decision IN ('accept', 'correct') THEN coalesce(corrected_value, value) ELSE value END AS final_value FROM j),
z AS (SELECT doc_id, status, final_value, status IN ('approved', 'corrected', 'auto_accepted') AND final_value IS NOT NULL AS exported, CASE WHEN only_review THEN 'review_only' WHEN only_row THEN 'extracted' ELSE 'reviewed' END AS origin FROM s)
"""


def reviewed(spark, sf):
    """Every document: French ones have another id than their decisions, so both sides have rows without a match."""
    doc = F.when(F.col("lang") == "fr", -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    rows = table(spark, sf, "documents").select(doc.alias("doc_id"), F.col("n_chars").alias("value"), (F.col("doc_id") % 4 == 0).alias("review_required"))
    return review.apply_decisions(rows, decisions(spark, sf), ["doc_id"])


@query("review_apply", REVIEW_SQL + "SELECT * FROM z")
def review_apply(spark, sf):
    return reviewed(spark, sf).select("doc_id", "status", "final_value", "exported", "origin")


@query("review_applied_status", REVIEW_SQL + """
SELECT d.doc_id, decision, CASE WHEN decision = 'not_applicable' THEN 'not_applicable' WHEN decision = 'reject' THEN 'rejected' WHEN z.doc_id IS NULL THEN 'not_found' WHEN z.exported THEN 'applied' ELSE 'not_exported' END AS applied_status
FROM d LEFT JOIN (SELECT * FROM z WHERE origin <> 'review_only') z ON d.doc_id = z.doc_id""")
def review_applied_status(spark, sf):
    final = reviewed(spark, sf).where("origin <> 'review_only'")
    return review.applied_status(decisions(spark, sf), final, ["doc_id"]).select("doc_id", "decision", "applied_status")


@query("review_gate_counts", "SELECT count(*) AS items, count(*) FILTER (l.doc_id IS NULL) AS active_items, count(*) FILTER (l.doc_id IS NULL) <= 0 AS ready FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang = 'en'")
def review_gate_counts(spark, sf):
    return review.gate(table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), decisions(spark, sf), ["doc_id"])


@query("review_categories", f"""
WITH d AS (SELECT doc_id, {DECISION_SQL} AS decision FROM labels),
q AS (SELECT x.doc_id, decision, CASE WHEN x.doc_id % 8 <> 0 THEN n_chars END AS v, lang, n_chars FROM documents x LEFT JOIN d ON x.doc_id = d.doc_id),
w AS (SELECT *, CASE WHEN decision IN ('reject', 'not_applicable') THEN 'resolved_done' WHEN decision IS NOT NULL THEN 'saved_unapplied' WHEN v IS NULL THEN 'missing' WHEN lang = 'fr' THEN 'validation_issue'
  WHEN lang = 'de' THEN 'scope_warning' WHEN n_chars < 1000 THEN 'warning_candidate' ELSE 'new_candidate' END AS category FROM q)
SELECT category, count(*) AS rows FROM w GROUP BY 1""")
def review_categories(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(decisions(spark, sf).select("doc_id", "decision"), "doc_id", "left")
    value = F.when(F.col("doc_id") % 8 != 0, F.col("n_chars"))
    status = F.when(F.col("lang") == "fr", "warn").otherwise("pass")
    none = F.lit(None).cast("string")
    why = review.reasons(F.lit("no"), none, F.when(F.col("n_chars") < 1000, 0.5).otherwise(1.0), F.lit(0.9), F.when(F.col("lang") == "de", "segment").otherwise("whole"), F.lit("whole"), F.lit("chars"), value, status, none, F.lit(None).cast("double"))
    applied = F.when(F.col("decision") == "reject", "rejected")
    named = docs.withColumn("category", review.category(F.col("decision").isNotNull(), applied, F.col("decision"), value, why))
    return named.groupBy("category").agg(F.count("*").alias("rows"))


@query("cell_states", WITH_ORDERS + """
SELECT entity, year, field_id, CASE WHEN value IS NOT NULL AND year % 2 = 0 THEN 'value_present' WHEN value IS NOT NULL THEN 'value_present_no_audit' WHEN year = 1997 THEN 'document_failed' WHEN year % 2 = 0 THEN 'blank_with_source_audit' ELSE 'blank_no_candidate' END AS state FROM c""")
def cell_states(spark, sf):
    none = F.lit(None).cast("string")
    failed = F.when(F.col("year") == 1997, "no document")
    state = review.cell_state(F.lit(True), F.col("value"), F.col("year") % 2 == 0, failed, none, none, none)
    return cells(spark, sf).select(*CELL, state.alias("state"))


@query("match_rate_verdict", """
WITH p AS (SELECT l_partkey, l_extendedprice / l_quantity AS a, p_retailprice AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT l_partkey, count(*) AS overlap, count(*) FILTER (abs(a - b) <= greatest(1.0, abs(b) * 0.2)) AS matches FROM p GROUP BY 1)
SELECT l_partkey, overlap, matches, round(matches / overlap, 4) AS rate, CASE WHEN overlap < 3 THEN 'unverifiable' WHEN round(matches / overlap, 4) >= 0.8 THEN 'corroborated' WHEN round(matches / overlap, 4) <= 0.1 THEN 'conflicts' ELSE 'weak' END AS verdict FROM m""")
def match_rate_verdict(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("a"))
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("b"))
    pairs = items.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return audit.match_rate(pairs, ["l_partkey"], E.within(F.col("a") - F.col("b"), F.col("b"), 1.0, 0.2))


@query("contradictory_maps", "SELECT c_nationkey AS item, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS concepts FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def contradictory_maps(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = audit.contradictory(rows.select(F.col("c_nationkey").alias("item"), F.col("o_orderstatus").alias("concept")))
    return out.withColumn("concepts", F.array_join("concepts", ","))


@query("duplicate_keys", "SELECT o_custkey, o_orderstatus, count(*) AS rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"])


@query("ambiguous_top", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS values FROM (SELECT *, max(o_orderpriority) OVER (PARTITION BY o_custkey) AS t FROM orders) WHERE o_orderpriority = t GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def ambiguous_top(spark, sf):
    return audit.ambiguous_top(table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], "o_orderpriority", "o_orderstatus")


@query("orphans", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return audit.orphans(table(spark, sf, "customer"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "c_custkey")


@query("field_coverage", WITH_ORDERS + """
SELECT field_id, count(value) AS filled, count(*) AS total, round(count(value) * 100.0 / count(*), 4) AS pct FROM c GROUP BY 1""")
def field_coverage(spark, sf):
    return audit.field_coverage(order_years(spark, sf), FIELDS)

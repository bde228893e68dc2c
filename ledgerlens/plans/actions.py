"""Queries on review actions: decisions, candidates, promotion, bulk actions, states and gates.

Cells are customers by year and order priority; a cell's first order is its queue row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import actions
from ..operators.actions import CELL
from .base import query, table


def rows(spark, sf):
    """Orders as rows of cells."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("field_id"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("state"))


def first_rows(spark, sf):
    from ..operators.merge import first_wins

    return first_wins(rows(spark, sf), CELL, "k")


ROWS = """
WITH r AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS field_id, o_orderkey AS k, o_totalprice AS price, o_orderstatus AS state FROM orders),
q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entity, year, field_id ORDER BY k) = 1)"""
DECIDE = "CASE k % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' WHEN 3 THEN 'not_applicable' WHEN 4 THEN 'weird' WHEN 5 THEN 'correct' END"
DECIDED = ROWS + f""",
d AS (SELECT CASE WHEN state = 'P' THEN -entity ELSE entity END AS entity, year, field_id, {DECIDE} AS decision, CASE WHEN k % 7 = 1 THEN CAST(k AS VARCHAR) WHEN k % 7 = 5 THEN ' ' END AS corrected_value FROM q),
x AS (SELECT d.*, CASE WHEN decision IS NULL OR decision = 'weird' THEN 'unknown_decision' WHEN decision = 'correct' AND trim(coalesce(corrected_value, '')) = '' THEN 'value_required' WHEN q.k IS NULL THEN 'not_in_queue' END AS refused FROM d LEFT JOIN q USING (entity, year, field_id))"""


def decided(spark, sf):
    """A decision for every cell; those of state P name an entity that is in no queue."""
    q = first_rows(spark, sf)
    return q.select(F.when(F.col("state") == "P", -F.col("entity")).otherwise(F.col("entity")).alias("entity"), "year", "field_id", F.expr(DECIDE).alias("decision"), F.expr("CASE WHEN k % 7 = 1 THEN CAST(k AS STRING) WHEN k % 7 = 5 THEN ' ' END").alias("corrected_value"))


@query("review_decisions_checked", DECIDED + " SELECT * FROM x")
def review_decisions_checked(spark, sf):
    return actions.checked(decided(spark, sf), first_rows(spark, sf), CELL).select(*CELL, "decision", "corrected_value", "refused")


def resolved_rows(spark, sf):
    """Saved reviews: cells of state F, with a note of their own."""
    q = first_rows(spark, sf).where("state = 'F'")
    kind = F.when(F.col("k") % 3 == 0, "not_applicable").otherwise("accept")
    applied = F.when(F.col("k") % 2 == 0, "applied").otherwise("")
    return q.select(*CELL, F.concat(F.lit("saved "), F.col("k").cast("string")).alias("note"), kind.alias("decision"), F.lit(None).cast("string").alias("corrected_value"), applied.alias("applied_status"))


RESOLVED = ",\ns AS (SELECT entity, year, field_id, 'saved ' || k AS note, CASE WHEN k % 3 = 0 THEN 'not_applicable' ELSE 'accept' END AS decision, CAST(NULL AS VARCHAR) AS corrected_value, CASE WHEN k % 2 = 0 THEN 'applied' ELSE '' END AS applied_status FROM q WHERE state = 'F')"


@query("review_upsert", DECIDED + RESOLVED + """
SELECT entity, year, field_id, CASE WHEN s.note IS NOT NULL THEN s.note ELSE 'queued ' || q.k END AS note, CASE WHEN x.decision IS NOT NULL THEN x.decision ELSE s.decision END AS decision, CASE WHEN x.decision IS NOT NULL THEN x.corrected_value ELSE s.corrected_value END AS corrected_value, CASE WHEN x.decision IS NOT NULL THEN '' ELSE s.applied_status END AS applied_status
FROM s FULL JOIN (SELECT * FROM x WHERE refused IS NULL) x USING (entity, year, field_id) LEFT JOIN q USING (entity, year, field_id)""")
def review_upsert(spark, sf):
    queue = first_rows(spark, sf).withColumn("note", F.concat(F.lit("queued "), F.col("k").cast("string")))
    new = decided(spark, sf).withColumn("applied_status", F.lit(""))
    return actions.upsert_reviews(resolved_rows(spark, sf), queue, new, CELL, ["decision", "corrected_value", "applied_status"])


ACTIONS_SQL = ",\na AS (SELECT c_custkey AS entity, '1-URGENT' AS field_id, CASE WHEN c_custkey % 3 <> 0 THEN 1993 END AS from_year, CASE WHEN c_custkey % 4 <> 0 THEN 1995 END AS to_year, 'holding' AS note FROM customer WHERE c_mktsegment = 'BUILDING')"


def scope_actions(spark, sf):
    """Customers of one segment declare a field out of scope for a range of years, open at some ends."""
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return c.select(F.col("c_custkey").alias("entity"), F.lit("1-URGENT").alias("field_id"), F.when(F.col("c_custkey") % 3 != 0, 1993).alias("from_year"), F.when(F.col("c_custkey") % 4 != 0, 1995).alias("to_year"), F.lit("holding").alias("note"))


@query("bulk_not_applicable", ROWS + ACTIONS_SQL + " SELECT q.entity, q.year, q.field_id, 'not_applicable' AS decision, note FROM q JOIN a USING (entity, field_id) WHERE year BETWEEN coalesce(from_year, 0) AND coalesce(to_year, 9999)")
def bulk_not_applicable(spark, sf):
    return actions.not_applicable(first_rows(spark, sf), scope_actions(spark, sf)).drop("corrected_value")


@query("stale_reviews_dropped", ROWS + RESOLVED + ACTIONS_SQL + " SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity = s.entity AND a.field_id = s.field_id AND s.decision = 'not_applicable' AND NOT s.year BETWEEN coalesce(from_year, 0) AND coalesce(to_year, 9999))")
def stale_reviews_dropped(spark, sf):
    return actions.drop_stale(resolved_rows(spark, sf), scope_actions(spark, sf))


MART_SQL = ",\nm AS (SELECT entity, year, field_id, k, 'set ' || (k % 2) AS dataset, CASE WHEN k % 9 = 0 THEN '' ELSE CAST(k % 5 AS VARCHAR) END AS value, CASE WHEN state = 'O' THEN 'missing_value' ELSE 'pass' END AS status FROM r),\nmc AS (SELECT * FROM m WHERE status = 'missing_value' AND value <> '' QUALIFY row_number() OVER (PARTITION BY entity, year, field_id, dataset, value ORDER BY k) = 1)"


def mart_rows(spark, sf):
    return rows(spark, sf).select(*CELL, "k", F.concat(F.lit("set "), (F.col("k") % 2).cast("string")).alias("dataset"), F.when(F.col("k") % 9 == 0, "").otherwise((F.col("k") % 5).cast("string")).alias("value"), F.when(F.col("state") == "O", "missing_value").otherwise("pass").alias("status"))


@query("mart_cell_candidates", ROWS + MART_SQL + " SELECT entity, year, field_id, dataset, value, k FROM mc")
def mart_cell_candidates(spark, sf):
    return actions.mart_candidates(mart_rows(spark, sf), "k").select(*CELL, "dataset", "value", "k")


def sources(spark, sf):
    r = rows(spark, sf)
    review = r.where("state = 'F'").select(*CELL, "k", F.col("k").cast("string").alias("value"))
    audit = r.where("state <> 'F'").select(*CELL, "k", F.when(F.col("k") % 4 != 0, F.concat(F.lit("a"), F.col("k").cast("string"))).alias("value"))
    return {"review": review, "audit": audit, "factbook": actions.mart_candidates(mart_rows(spark, sf), "k").select(*CELL, "k", "value")}


CANDIDATES = ROWS + MART_SQL + """,
c AS (
  SELECT *, 'review:' || place AS candidate_id, 'review' AS source FROM (SELECT entity, year, field_id, CAST(k AS VARCHAR) AS value, row_number() OVER w - 1 AS place FROM r WHERE state = 'F' WINDOW w AS (PARTITION BY entity, year, field_id ORDER BY k)) WHERE place < 2
  UNION ALL SELECT *, 'audit:' || place, 'audit' FROM (SELECT entity, year, field_id, CASE WHEN k % 4 <> 0 THEN 'a' || k END AS value, row_number() OVER w - 1 AS place FROM r WHERE state <> 'F' WINDOW w AS (PARTITION BY entity, year, field_id ORDER BY k)) WHERE place < 2 AND value IS NOT NULL
  UNION ALL SELECT *, 'factbook:' || place, 'factbook' FROM (SELECT entity, year, field_id, value, row_number() OVER w - 1 AS place FROM mc WINDOW w AS (PARTITION BY entity, year, field_id ORDER BY k)) WHERE place < 2)"""


@query("cell_candidate_list", CANDIDATES + " SELECT entity, year, field_id, candidate_id, value FROM c")
def cell_candidate_list(spark, sf):
    return actions.candidates(sources(spark, sf), CELL, "k", 2).select(*CELL, "candidate_id", "value")


CHOICE = "CASE k % 6 WHEN 0 THEN 'review:0' WHEN 1 THEN 'audit:1' WHEN 2 THEN 'factbook:0' WHEN 3 THEN 'review:9' ELSE '' END"
WHAT = "CASE k % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' ELSE 'accept' END"


@query("candidate_choice_saved", CANDIDATES + f""",
h AS (SELECT entity, year, field_id, {CHOICE} AS candidate_id, {WHAT} AS decision, CASE WHEN k % 8 = 1 THEN 'v' ELSE '' END AS corrected_value FROM q),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY entity, year, field_id ORDER BY CASE source WHEN 'review' THEN 0 WHEN 'factbook' THEN 1 ELSE 2 END, place) = 1),
j AS (SELECT h.*, CASE WHEN h.candidate_id <> '' THEN c.source ELSE b.source END AS source, CASE WHEN h.candidate_id <> '' THEN c.value ELSE b.value END AS v, c.source IS NULL AS lost FROM h LEFT JOIN c ON c.entity = h.entity AND c.year = h.year AND c.field_id = h.field_id AND c.candidate_id = h.candidate_id LEFT JOIN b ON b.entity = h.entity AND b.year = h.year AND b.field_id = h.field_id)
SELECT entity, year, field_id, source, CASE decision WHEN 'correct' THEN corrected_value WHEN 'accept' THEN v END AS saved_value,
  CASE WHEN decision = 'correct' AND corrected_value = '' THEN 'value_required' WHEN candidate_id <> '' AND lost THEN 'candidate_not_found' WHEN decision = 'accept' AND v IS NULL THEN 'value_required' END AS refused FROM j""")
def candidate_choice_saved(spark, sf):
    q = first_rows(spark, sf)
    choices = q.select(*CELL, F.expr(CHOICE).alias("candidate_id"), F.expr(WHAT).alias("decision"), F.expr("CASE WHEN k % 8 = 1 THEN 'v' ELSE '' END").alias("corrected_value"))
    return actions.save_choices(choices, actions.candidates(sources(spark, sf), CELL, "k", 2), CELL).select(*CELL, "source", "saved_value", "refused")


@query("synthetic_review_rows", ROWS + """,
a AS (SELECT * FROM r WHERE state <> 'F' QUALIFY row_number() OVER (PARTITION BY entity, year, field_id ORDER BY k) = 1)
SELECT q.entity, q.year, q.field_id, coalesce(c_name, '') AS name, CASE q.field_id WHEN '1-URGENT' THEN 'urgent' ELSE q.field_id END AS field_name, q.price AS existing_value, a.price AS extracted_value, CASE WHEN a.k IS NOT NULL THEN 'usd' WHEN q.field_id = '1-URGENT' THEN 'eur' END AS unit
FROM q LEFT JOIN customer ON c_custkey = q.entity LEFT JOIN a USING (entity, year, field_id)""")
def synthetic_review_rows(spark, sf):
    q = first_rows(spark, sf)
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"))
    wide = actions.with_names(q.select(*CELL, F.col("price").alias("value")), names, "entity")
    fields = spark.createDataFrame([("1-URGENT", "urgent", "eur")], "field_id string, field_name string, target_unit string")
    audit = rows(spark, sf).where("state <> 'F'").select(*CELL, "k", F.col("price").alias("value"), F.lit("usd").alias("unit"))
    return actions.synthetic_rows(q, wide, fields, audit, "k").drop("reason")


INFERRED = ROWS + """,
i AS (SELECT entity, year, field_id, CASE WHEN k % 5 = 0 THEN 'low_confidence' ELSE 'high_confidence' END AS status, CASE WHEN k % 11 = 0 THEN NULL ELSE price END AS value FROM q),
e AS (SELECT entity, year, field_id, CASE WHEN k % 4 = 0 THEN price + 2 WHEN k % 4 = 1 THEN price * 1.1 WHEN k % 4 = 2 THEN NULL ELSE price END AS value, CASE WHEN k % 3 = 0 THEN 'pass' ELSE 'fail' END AS validation_status FROM q WHERE state = 'F'),
p AS (SELECT i.entity, i.year, i.field_id, i.value, count(*) OVER (PARTITION BY i.entity, i.field_id) AS years, e.value AS existing_value, validation_status FROM i LEFT JOIN e USING (entity, year, field_id) WHERE status = 'high_confidence' AND i.value IS NOT NULL),
plan AS (SELECT *, CASE WHEN validation_status IS NULL THEN CASE WHEN years >= 2 THEN 'promote' ELSE 'candidate_single_year' END WHEN validation_status = 'fail' AND abs(existing_value - value) > greatest(1.0, abs(value) * 0.005) THEN 'suspect_existing_value' ELSE 'filled' END AS plan FROM p)"""


def plan(spark, sf):
    q = first_rows(spark, sf)
    k, price = F.col("k"), F.col("price")
    inferred = q.select(*CELL, F.when(k % 5 == 0, "low_confidence").otherwise("high_confidence").alias("status"), F.when(k % 11 != 0, price).alias("value"))
    value = F.when(k % 4 == 0, price + 2).when(k % 4 == 1, price * 1.1).when(k % 4 == 3, price)
    existing = q.where("state = 'F'").select(*CELL, value.alias("value"), F.when(k % 3 == 0, "pass").otherwise("fail").alias("validation_status"))
    return actions.promotion_plan(inferred, existing)


@query("promotion_plan", INFERRED + " SELECT entity, year, field_id, value, years, plan FROM plan")
def promotion_plan(spark, sf):
    return plan(spark, sf).select(*CELL, "value", "years", "plan")


@query("promotion_applied", INFERRED + " SELECT entity, year, field_id, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.entity = plan.entity AND r.year = plan.year AND r.field_id = plan.field_id AND state = 'P') THEN 'existing_review' END AS refused FROM plan WHERE plan = 'promote'")
def promotion_applied(spark, sf):
    """Cells with an order of state P have a review already."""
    return actions.apply_plan(plan(spark, sf), rows(spark, sf).where("state = 'P'"), F.lit("by identity")).select(*CELL, "refused")


@query("expansion_to_other_years", INFERRED + " SELECT plan.entity, plan.year, plan.field_id, plan.value, q.year AS from_cell_year FROM plan JOIN q ON q.entity = plan.entity AND q.field_id = plan.field_id AND q.state = 'F' WHERE plan = 'promote'")
def expansion_to_other_years(spark, sf):
    return actions.other_years(plan(spark, sf), first_rows(spark, sf).where("state = 'F'"))


@query("blank_year_counts", ROWS + ", v AS (SELECT entity, year, field_id, CASE WHEN state = 'F' THEN price END AS value FROM q) SELECT *, (SELECT count(*) FROM v o WHERE o.entity = v.entity AND o.field_id = v.field_id AND o.year <> v.year AND o.value IS NULL) AS blank_years FROM v")
def blank_year_counts(spark, sf):
    return actions.blank_years(first_rows(spark, sf).select(*CELL, F.when(F.col("state") == "F", F.col("price")).alias("value")))


REASON = "CASE k % 5 WHEN 0 THEN 'unit_unknown; identity_group_mismatch:r1' WHEN 1 THEN 'identity_group_mismatch:r2,identity_group_mismatch:r1' WHEN 2 THEN 'identity_group_mismatch:r3;identity_group_mismatch:r3' WHEN 3 THEN 'validation_fail' END"


@query("group_decisions", ROWS + f""",
g AS (SELECT DISTINCT entity, year, field_id, trim(x) AS group_id FROM (SELECT entity, year, field_id, unnest(regexp_split_to_array({REASON}, '[;,]')) AS x FROM q) WHERE starts_with(trim(x), 'identity_group_mismatch'))
SELECT entity, year, field_id, group_id, CASE WHEN group_id LIKE '%r1' THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN group_id LIKE '%r1' THEN 'agreed' ELSE 'reconciliation group decision: ' || group_id END AS note FROM g WHERE group_id NOT LIKE '%r2'""")
def group_decisions(spark, sf):
    queue = first_rows(spark, sf).withColumn("review_reason", F.expr(REASON))
    groups = spark.createDataFrame([("identity_group_mismatch:r1", "accept", None, "agreed"), ("identity_group_mismatch:r3", "reject", None, None)], "group_id string, decision string, corrected_value string, note string")
    return actions.group_decisions(queue, groups).drop("corrected_value")


@query("gate_status", ROWS + RESOLVED + """,
j AS (SELECT q.k, s.decision, s.applied_status FROM q LEFT JOIN s USING (entity, year, field_id)),
n AS (SELECT count(*) AS items, count(*) FILTER (decision IS NULL OR NOT (applied_status = 'applied' OR decision = 'not_applicable')) AS active_items, count(*) FILTER (decision IS NOT NULL AND NOT (applied_status = 'applied' OR decision = 'not_applicable')) AS unapplied_items FROM j)
SELECT *, 'active_review_items=' || active_items || ' exceeds 5|saved_unapplied_reviews=' || unapplied_items || ' exceeds 0|missing_final_outputs=source_audit|algorithm_audit_missing|regression_stale=40.5d exceeds 30d' AS blocking, false AS ready FROM n""")
def gate_status(spark, sf):
    out = actions.gate_status(first_rows(spark, sf), resolved_rows(spark, sf), CELL, ["source_audit"], {"regression": 40.5}, {"algorithm_audit": 14, "regression": 30}, most_active=5)
    return out.withColumn("blocking", F.array_join("blocking", "|"))


@query("cell_meta", ROWS + """,
v AS (SELECT *, CASE WHEN state = 'P' THEN NULL ELSE price END AS value, CASE WHEN k % 3 = 0 THEN '' ELSE 'm' || (k % 2) END AS method, CASE WHEN k % 4 = 0 THEN 'warn' WHEN k % 4 = 1 THEN '' ELSE 'pass' END AS status FROM r)
SELECT entity, year, field_id, bool_or(value IS NOT NULL) AS has_value, arg_max(value, k) FILTER (value IS NOT NULL) AS value, arg_max(method, k) FILTER (value IS NOT NULL AND method <> '') AS method, arg_max(status, k) FILTER (status <> '') AS status FROM v GROUP BY 1, 2, 3""")
def cell_meta(spark, sf):
    return actions.cell_meta(_cell_values(spark, sf), "k").select(*CELL, "has_value", "value", "method", "status")


def _cell_values(spark, sf):
    k = F.col("k")
    r = rows(spark, sf)
    return r.select(*CELL, "k", "state", F.when(F.col("state") != "P", F.col("price")).alias("value"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("m"), (k % 2).cast("string"))).alias("method"), F.when(k % 4 == 0, "warn").when(k % 4 == 1, "").otherwise("pass").alias("status"), F.when(k % 6 == 0, "True").otherwise("0").alias("review_required"))


@query("cell_rows_by_method", ROWS + """
SELECT entity, year, field_id, arg_min(coalesce(CASE WHEN state <> 'P' THEN price END, -1), k) AS value, coalesce(string_agg(DISTINCT CASE WHEN k % 3 <> 0 THEN 'm' || (k % 2) END, ';' ORDER BY CASE WHEN k % 3 <> 0 THEN 'm' || (k % 2) END), '') AS methods, bool_or(k % 6 = 0) AS review_required FROM r GROUP BY 1, 2, 3""")
def cell_rows_by_method(spark, sf):
    values = _cell_values(spark, sf).withColumn("value", F.coalesce("value", F.lit(-1.0)))
    return actions.cell_rows(values, "k")


@query("resolutions_written_back", ROWS + """
SELECT r.k, CASE WHEN q.state = 'F' THEN q.k % 4 ELSE 0 END AS corroboration_count, CASE WHEN q.state = 'F' THEN q.k % 2 ELSE 0 END AS conflict_count, CASE WHEN q.state <> 'F' THEN '' WHEN q.k % 2 = 1 THEN 'conflicted' ELSE 'auto_confirmed' END AS corroboration_status, CASE WHEN q.state = 'F' THEN 'a;b' ELSE '' END AS corroboration_refs
FROM r JOIN q USING (entity, year, field_id)""")
def resolutions_written_back(spark, sf):
    k = F.col("k")
    found = first_rows(spark, sf).where("state = 'F'").select(*CELL, (k % 4).alias("corroboration_count"), (k % 2).alias("conflict_count"), F.when(k % 2 == 1, "conflicted").otherwise("auto_confirmed").alias("resolution"), F.array(F.lit("a"), F.lit("b")).alias("sources"))
    return actions.write_back(rows(spark, sf), found).select("k", "corroboration_count", "conflict_count", "corroboration_status", "corroboration_refs")


STATE = "CASE k % 5 WHEN 0 THEN 'value_present' WHEN 1 THEN 'value_present_no_audit' WHEN 2 THEN 'blank_no_candidate' WHEN 3 THEN 'blank_with_source_audit' ELSE 'document_failed' END"
RESOLUTION = "CASE k % 7 WHEN 0 THEN 'conflicted' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'needs_reconciliation' WHEN 3 THEN 'auto_confirmed' END"


@query("cell_state_overlays", ROWS + f""",
a AS (SELECT k, {STATE} AS state, {RESOLUTION} AS res, k % 2 = 0 AS weak, k % 3 = 0 AS mart FROM q),
b AS (SELECT *, CASE WHEN state = 'value_present' AND res <> 'auto_confirmed' THEN 'corroboration_' || res ELSE state END AS s FROM a),
c AS (SELECT *, CASE WHEN weak AND s IN ('value_present', 'value_present_no_audit', 'corroboration_needs_review') THEN 'corroboration_weak' ELSE s END AS t FROM b)
SELECT k, CASE WHEN mart AND t LIKE 'blank%' THEN 'factbook_candidate' ELSE t END AS state FROM c""")
def cell_state_overlays(spark, sf):
    q = first_rows(spark, sf)
    return q.select("k", actions.overlays(F.expr(STATE), F.expr(RESOLUTION), F.col("k") % 2 == 0, F.col("k") % 3 == 0).alias("state"))


@query("zero_corroboration_cells", ROWS + " SELECT entity, year, field_id FROM q WHERE k % 3 <> 0 AND k % 4 = 0 AND k % 5 < 2 AND k % 5 <> 1")
def zero_corroboration_cells(spark, sf):
    k = F.col("k")
    cells = first_rows(spark, sf).select(*CELL, F.when(k % 3 == 0, "1").otherwise("").alias("review_required"), (k % 4).alias("corroboration_count"), F.when(k % 5 != 0, k % 5).alias("conflict_count"))
    return actions.zero_corroboration(cells).select(*CELL)


@query("review_states", ROWS + RESOLVED + MART_SQL + """,
qq AS (SELECT entity, year, field_id, count(*) AS n, bool_or(k % 3 <> 0) AS valued FROM r WHERE state <> 'F' GROUP BY 1, 2, 3), mm AS (SELECT entity, year, field_id, count(*) AS n FROM mc GROUP BY 1, 2, 3)
SELECT q.entity, q.year, q.field_id, s.decision IS NOT NULL AS saved, s.decision IS NOT NULL AND s.applied_status <> 'applied' AS saved_not_applied, coalesce(qq.n, 0) + coalesce(mm.n, 0) AS candidate_count, q.k % 2 = 0 AS final_value_present,
  coalesce(valued, false) OR mm.n IS NOT NULL AS can_accept, qq.n IS NOT NULL OR s.decision IS NOT NULL AS can_reject, s.decision IS NOT NULL AND q.k % 2 = 1 AS apply_needed
FROM q LEFT JOIN qq USING (entity, year, field_id) LEFT JOIN mm USING (entity, year, field_id) LEFT JOIN s USING (entity, year, field_id)""")
def review_states(spark, sf):
    k = F.col("k")
    cells = first_rows(spark, sf).select(*CELL, F.when(k % 2 == 0, k).alias("value"))
    queue = rows(spark, sf).where("state <> 'F'").select(*CELL, F.when(k % 3 != 0, k).alias("value"))
    return actions.review_state(cells, queue, resolved_rows(spark, sf), actions.mart_candidates(mart_rows(spark, sf), "k")).drop("value")


@query("differences_to_existing", ROWS + " SELECT k, round(price - k, 4) AS difference, round((price - k) / nullif(CAST(k AS DOUBLE), 0), 6) AS pct FROM q")
def differences_to_existing(spark, sf):
    d = first_rows(spark, sf).select("k", actions.against_existing(F.col("price"), F.col("k").cast("double")).alias("d"))
    return d.select("k", F.round("d.difference", 4).alias("difference"), F.round("d.pct", 6).alias("pct"))


PERIOD = "CASE c_custkey % 5 WHEN 0 THEN '1995' WHEN 1 THEN '1996(3)' WHEN 2 THEN '1996(12)' WHEN 3 THEN 'FY96' ELSE ' 1997 ' END"


@query("notes_imported", f"""
WITH n AS (SELECT c_custkey, '株式会社 ' || c_name AS name, {PERIOD} AS period FROM customer),
p AS (SELECT *, regexp_extract(period, '^\\s*(\\d{{4}})(?:\\((\\d{{1,2}})\\))?\\s*$', ['y', 'm']) AS t, (c_custkey % 2 = 0) AS known FROM n),
j AS (SELECT *, try_cast(t.y AS INT) AS y, coalesce(try_cast(t.m AS INT), CASE WHEN known THEN 3 END) AS m FROM p)
SELECT c_custkey, CASE WHEN y IS NULL THEN 'period_unparsed' WHEN NOT known THEN 'company_unmatched' WHEN m <> 3 OR y NOT IN (1995, 1996) THEN 'year_unmatched' END AS refused, CASE WHEN known AND m = 3 AND y IN (1995, 1996) THEN y - 1 END AS year FROM j""")
def notes_imported(spark, sf):
    """Notes on companies by name and period; the master knows every second company, whose years end in March 1995 and 1996."""
    c = table(spark, sf, "customer")
    notes = c.select("c_custkey", F.concat(F.lit("株式会社 "), "c_name").alias("name"), P.note_period(F.expr(PERIOD)).alias("period"))
    known = c.where("c_custkey % 2 = 0").select(P.company_name(F.col("c_name")).alias("alias"), F.col("c_custkey").alias("entity"), F.lit(3).alias("month"))
    years = known.select("entity", F.explode(F.array(F.lit(1995), F.lit(1996))).alias("end_year"), F.lit(3).alias("end_month")).withColumn("year", F.col("end_year") - 1)
    return actions.imported_notes(notes, known, years).select("c_custkey", "refused", "year")


@query("run_report_counters", ROWS + " SELECT (SELECT count(*) FROM customer) AS targets, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS resolved, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS transitions, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM r WHERE state = 'P') AS missing, (SELECT count(*) FROM r WHERE k % 3 = 0) AS failed_checks, (SELECT count(*) FROM q) AS to_review")
def run_report_counters(spark, sf):
    targets = table(spark, sf, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "resolved").otherwise("failed").alias("resolution_status"), (F.col("c_acctbal") < 0).alias("transition"))
    values = rows(spark, sf).select("k", F.when(F.col("state") != "P", F.col("price")).alias("value"))
    results = rows(spark, sf).select(F.when(F.col("k") % 3 == 0, "fail").otherwise("pass").alias("status"))
    return actions.run_counters(targets, values, results, first_rows(spark, sf))


LINE = "CASE c_custkey % 6 WHEN 0 THEN '# Run Report: x' WHEN 1 THEN '- rows ' || CAST(c_custkey AS STRING) || ': ' || CAST(c_custkey * 2 AS STRING) WHEN 2 THEN '| ' || c_name || ' | no document |' WHEN 3 THEN '|---|---|' WHEN 4 THEN '| company_year_id | failure_reason |' ELSE '' END"


@query("run_report_read", "SELECT 'summary' AS kind, 'rows ' || c_custkey AS key, CAST(c_custkey * 2 AS VARCHAR) AS value FROM customer WHERE c_custkey % 6 = 1 UNION ALL SELECT 'failure', c_name, 'no document' FROM customer WHERE c_custkey % 6 = 2")
def run_report_read(spark, sf):
    """The lines of a report, one a customer, read back."""
    return actions.read_run_report(table(spark, sf, "customer").select(F.expr(LINE).alias("value")))


@query("resolution_distribution", ROWS + " SELECT CASE WHEN k % 3 = 0 THEN 'conflicted' ELSE 'auto_confirmed' END AS resolution, count(*) AS cells FROM q GROUP BY 1")
def resolution_distribution(spark, sf):
    return first_rows(spark, sf).groupBy(F.when(F.col("k") % 3 == 0, "conflicted").otherwise("auto_confirmed").alias("resolution")).agg(F.count("*").alias("cells"))

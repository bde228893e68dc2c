"""Queries on audits of published tables and definitions, the mapping store's backfill, concepts and fact lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, paging
from ..operators.actions import CELL
from .actions import ROWS, first_rows, rows
from .base import query, table

DECISION = "CASE k % 6 WHEN 0 THEN 'accept' WHEN 1 THEN 'correct' WHEN 2 THEN 'reject' WHEN 3 THEN 'not_applicable' WHEN 4 THEN 'maybe' ELSE ' Accept ' END"
APPLIED = "CASE k % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' WHEN 2 THEN 'not_applicable' WHEN 3 THEN '' ELSE 'Applied ' END"


def tables_(spark, sf):
    """Published tables that disagree in known ways: final rows of states F and O, reviews of all cells (those of state P twice), audits of F and P, a wide table that lacks the customers of one segment."""
    r, q = rows(spark, sf), first_rows(spark, sf)
    k, text = F.col("k"), lambda c: c.cast("string")
    final = r.where("state <> 'P'").select(*CELL, F.when(k % 7 != 0, text(k % 50)).otherwise("").alias("value"), (k % 2).alias("score"), F.col("k").alias("ordinal"))
    one = q.select(*CELL, "state", F.expr(DECISION).alias("decision"), F.when(k % 4 == 0, text(k % 50)).alias("corrected_value"), F.expr(APPLIED).alias("applied_status"), F.when(k % 3 == 0, F.concat(text(k % 50), F.lit(".0"))).alias("applied_value"))
    resolved = one.unionByName(one.where("state = 'P'")).drop("state")
    out = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"))
    wide = q.where("state <> 'P'").join(out, "entity", "left_anti").select(*CELL, text(k % 50).alias("value"))
    detail = q.where("state <> 'O'").select(*CELL, F.lit(True).alias("saved"), F.expr(APPLIED).alias("applied_status"))
    mirrors = spark.createDataFrame([("cell_resolutions", 10, 9), ("concept_mappings", 5, 5)], "table string, rows long, mirror_rows long")
    return final, resolved, r.where("state <> 'O'").select(*CELL), wide, detail, mirrors


CONSISTENCY = ROWS + f""",
f AS (SELECT entity, year, field_id, CASE WHEN k % 7 <> 0 THEN CAST(k % 50 AS VARCHAR) ELSE '' END AS value, k % 2 AS score, k AS ordinal FROM r WHERE state <> 'P'),
v0 AS (SELECT entity, year, field_id, state, {DECISION} AS decision, CASE WHEN k % 4 = 0 THEN k % 50 END AS corrected, {APPLIED} AS applied_status, CASE WHEN k % 3 = 0 THEN k % 50 END AS applied_value FROM q),
v AS (SELECT * FROM v0 UNION ALL SELECT * FROM v0 WHERE state = 'P'),
c AS (SELECT entity, year, field_id, arg_max(value, ordinal) AS last, bool_or(value <> '') AS valued, count(*) AS n FROM f GROUP BY 1, 2, 3),
j AS (SELECT v.*, lower(trim(applied_status)) AS st, c.n IS NOT NULL AS there, try_cast(last AS INT) AS last, coalesce(last, '') <> '' AS shown FROM v LEFT JOIN c USING (entity, year, field_id)),
a AS (SELECT DISTINCT entity, year, field_id FROM r WHERE state <> 'O'),
b AS (SELECT entity, year, field_id, arg_max(value, (score, ordinal)) AS expected FROM f GROUP BY 1, 2, 3),
w AS (SELECT entity, year, field_id, CAST(k % 50 AS VARCHAR) AS stored FROM q WHERE state <> 'P' AND entity NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
t AS (SELECT entity, year, field_id, arg_max(n, score) AS n FROM (SELECT entity, year, field_id, score, count(DISTINCT value) AS n FROM f WHERE value <> '' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
z AS (
  SELECT 'review_resolved_duplicate_keys' AS finding, 'P1' AS severity, (SELECT count(*) FROM v0 WHERE state = 'P') AS rows
  UNION ALL SELECT 'invalid_review_decision', 'P1', count(*) FILTER (decision = 'maybe') FROM v
  UNION ALL SELECT 'applied_review_missing_final', 'P0', count(*) FILTER (st = 'applied' AND NOT there) FROM j
  UNION ALL SELECT 'applied_review_value_mismatch', 'P1', count(*) FILTER (st = 'applied' AND there AND ((decision = 'correct' AND corrected IS NOT NULL AND corrected IS DISTINCT FROM last) OR (applied_value IS NOT NULL AND applied_value IS DISTINCT FROM last))) FROM j
  UNION ALL SELECT 'not_applicable_review_present_in_final', 'P1', count(*) FILTER ((st = 'not_applicable' AND shown) OR (st = 'applied' AND there AND decision = 'not_applicable')) FROM j
  UNION ALL SELECT 'rejected_review_present_in_final', 'P1', count(*) FILTER (st = 'rejected' AND shown) FROM j
  UNION ALL SELECT 'final_value_missing_source_audit', 'P1', (SELECT count(*) FROM c ANTI JOIN a USING (entity, year, field_id) WHERE valued)
  UNION ALL SELECT 'source_audit_without_final_value', 'P2', (SELECT count(*) FROM a ANTI JOIN (SELECT * FROM c WHERE valued) c USING (entity, year, field_id))
  UNION ALL SELECT 'final_long_missing_wide_row', 'P1', (SELECT count(*) FROM (SELECT DISTINCT entity, year FROM b ANTI JOIN w USING (entity, year)))
  UNION ALL SELECT 'final_long_wide_value_mismatch', 'P1', (SELECT count(*) FROM b JOIN w USING (entity, year, field_id) WHERE expected <> stored)
  UNION ALL SELECT 'final_duplicate_top_score_ambiguous', 'P2', (SELECT count(*) FROM t WHERE n > 1)
  UNION ALL SELECT 'final_master_long_duplicate_keys_observed', 'info', (SELECT count(*) FROM c WHERE n > 1)
  UNION ALL SELECT 'cell_detail_review_state_mismatch', 'P1', count(*) FILTER (state = 'O') FROM v
  UNION ALL SELECT 'semantics_csv_mirror_stale', 'P2', 1)"""


@query("state_consistency", CONSISTENCY + " SELECT * FROM z WHERE rows > 0")
def state_consistency(spark, sf):
    return governance.consistency(*tables_(spark, sf))


@query("state_consistency_status", CONSISTENCY + " SELECT 'needs_attention' AS status, count(*) FILTER (severity IN ('P0', 'P1')) AS p0_p1, count(*) AS findings FROM z WHERE rows > 0")
def state_consistency_status(spark, sf):
    return governance.overall(governance.consistency(*tables_(spark, sf)))


def definitions(spark, sf):
    """Parts as field definitions (the words of their type are tags), brands as concepts of mappings, and some sections."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit("f"), key.cast("string"))
    scope = F.when(key % 2 == 0, "consolidated").otherwise("standalone")
    filters = F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("CurrentYearDuration"), F.when(key % 2 == 0, "ConsolidatedMember").otherwise("NonConsolidatedMember")))
    fields = p.select(name.alias("field_id"), F.array(F.col("p_name"), F.lit("")).alias("tags"), scope.alias("scope"), filters.alias("filters"))
    final = table(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("field_id"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("string")).otherwise("nan").alias("value"))
    concepts = p.select(F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"))).otherwise(name).alias("concept"))
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    mappings = c.select(F.when(ck % 9 != 0, F.concat(F.lit("i"), (ck % 40).cast("string"))).otherwise("").alias("item"), F.when(ck % 11 != 0, F.concat(F.lit("f"), (ck % 60).cast("string"))).alias("concept"), F.when(ck % 2 == 0, "confirmed").otherwise("proposed").alias("status"))
    sections = spark.createDataFrame([("orders", ["a"], ["h"]), ("review_x", ["b", "c"], []), ("review_y", [], ["h"])], "section string, targets array<string>, headings array<string>")
    return fields, final, concepts, mappings, sections


@query("definition_findings", """
WITH fd AS (SELECT 'f' || p_partkey AS field_id, p_name AS tag, p_partkey % 2 AS odd, p_partkey % 5 = 0 AS bare FROM part),
fi AS (SELECT 'f' || l_partkey AS field_id, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
co AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey ELSE 'f' || p_partkey END AS concept FROM part),
m AS (SELECT CASE WHEN c_custkey % 9 <> 0 THEN 'i' || (c_custkey % 40) ELSE '' END AS item, CASE WHEN c_custkey % 11 <> 0 THEN 'f' || (c_custkey % 60) END AS concept, c_custkey % 2 = 0 AS sure FROM customer),
z AS (
  SELECT 'duplicate_tag' AS kind, CASE WHEN count(*) = 2 AND count(DISTINCT odd) = 2 AND NOT bool_or(bare) THEN 'low' ELSE 'medium' END AS severity, tag AS target, string_agg(field_id, ',' ORDER BY field_id) AS detail FROM fd GROUP BY tag HAVING count(*) > 1
  UNION ALL SELECT 'contradictory_mapping', 'high', item, string_agg(DISTINCT concept, ',' ORDER BY concept) FROM m WHERE sure AND item <> '' AND concept IS NOT NULL GROUP BY item HAVING count(DISTINCT concept) > 1
  UNION ALL SELECT 'low_coverage_concept', CASE WHEN n IS NULL THEN 'info' ELSE 'medium' END, field_id, CAST(coalesce(n, 0) AS VARCHAR) FROM fd LEFT JOIN fi USING (field_id) WHERE coalesce(n, 0) < 30
  UNION ALL SELECT 'orphan_concept', 'medium', concept, '' FROM co WHERE concept NOT IN (SELECT field_id FROM fd) AND concept NOT IN (SELECT concept FROM m WHERE sure AND concept IS NOT NULL)
  UNION ALL SELECT 'unconfirmed_concept', 'low', field_id, CAST((SELECT count(*) FROM m WHERE NOT sure AND concept = field_id) AS VARCHAR) FROM fd WHERE field_id NOT IN (SELECT concept FROM m WHERE sure AND concept IS NOT NULL)
  UNION ALL VALUES ('review_section_debt', 'low', 'review_x', 'b,c'), ('review_section_debt', 'low', 'review_y', ''), ('review_section_debt_summary', 'medium', 'sections', '2/3'))
SELECT *, 'finding_' || left(sha1(kind || '|' || target || '|' || detail), 16) AS finding_id FROM z""")
def definition_findings(spark, sf):
    return governance.definition_findings(*definitions(spark, sf), low=30, many=2)


@query("risk_flags", ROWS + """,
f AS (SELECT 'f' || p_partkey AS field_id, p_size / 50.0 AS coverage, p_size % 10 AS synonyms, p_partkey % 9 AS tags, p_partkey % 3 AS local_rows, CASE WHEN p_partkey % 2 = 0 THEN 'XBRL_CSV' ELSE 'LLM' END AS method FROM part)
SELECT 'medium' AS severity, 'field_coverage' AS area, field_id AS target, 'low_coverage' AS flag FROM f WHERE coverage > 0 AND coverage < 0.75
UNION ALL SELECT 'low', 'field_definition', field_id, 'many_candidates' FROM f WHERE synonyms >= 8 OR tags >= 8
UNION ALL SELECT 'low', 'field_method', field_id, 'local_rule_supplements_xbrl_field' FROM f WHERE local_rows > 0 AND method = 'XBRL_CSV'
UNION ALL SELECT 'low', 'section_config', 'big', 'large_section_target_surface'
UNION ALL SELECT 'high', 'review_application', entity || '_' || year || ':' || field_id, 'saved_review_not_applied' FROM q WHERE k % 6 IN (0, 1, 5) AND k % 5 <> 0""")
def risk_flags(spark, sf):
    p = table(spark, sf, "part")
    fields = p.select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("field_id"), (F.col("p_size") / 50).alias("coverage"), (F.col("p_size") % 10).alias("synonyms"), (F.col("p_partkey") % 9).alias("tags"), (F.col("p_partkey") % 3).alias("local_rows"), F.when(F.col("p_partkey") % 2 == 0, "XBRL_CSV").otherwise("LLM").alias("preferred_method"))
    sections = spark.createDataFrame([("big", [str(i) for i in range(8)]), ("small", ["a"])], "section string, targets array<string>")
    resolved = first_rows(spark, sf).select(*CELL, F.expr(DECISION).alias("decision"), F.when(F.col("k") % 5 == 0, " applied ").otherwise("x").alias("applied_status"))
    return governance.risk_flags(fields, sections, resolved)


ID = "'map_' || left(sha1(item || '|' || concept || '|' || action || '|' || decided_by || '|' || scope), 16) AS mapping"
BACKFILL = ROWS + f""",
s AS (
  SELECT 'm' || p_partkey AS item, trim(x) AS concept, 'map' AS action, 'proposed' AS status, 'rule:tag_match' AS decided_by, '' AS scope FROM (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ' ; '), ';')) AS x FROM part) WHERE trim(x) <> ''
  UNION ALL SELECT 'm' || p_partkey, CASE WHEN p_partkey % 6 IN (0, 2, 3) AND p_size % 4 > 0 THEN p_brand ELSE '' END, CASE p_partkey % 6 WHEN 0 THEN 'map' WHEN 1 THEN 'ignore' WHEN 2 THEN 'map' ELSE 'different_scope' END, CASE WHEN p_partkey % 6 = 2 THEN 'proposed' ELSE 'confirmed' END, 'person:field_mappings', '' FROM part WHERE p_partkey % 6 < 4 AND NOT (p_partkey % 6 = 0 AND p_size % 4 = 0)
  UNION ALL SELECT DISTINCT 'local_' || left(sha1(o_orderstatus || '|' || o_orderpriority || '|' || o_custkey), 16), o_orderpriority, 'map', 'confirmed', 'rule:local_table', '' FROM orders
  UNION ALL SELECT 'review_' || left(sha1(entity || '|' || year || '|' || field_id || '|' || k), 16), CASE WHEN k % 6 = 3 THEN '' ELSE field_id END, CASE WHEN k % 6 = 3 THEN 'ignore' ELSE 'map' END, 'confirmed', 'person:review', CASE WHEN k % 6 = 3 THEN CAST(entity AS VARCHAR) ELSE '' END FROM q WHERE (k % 6 IN (0, 1) AND k % 5 = 0) OR (k % 6 = 3 AND k % 5 = 2)
  UNION ALL SELECT '', 'total', 'ignore', 'confirmed', 'person:exclusions', c_custkey || '|' || CASE WHEN c_custkey % 2 = 0 THEN '1995' ELSE '' END || '|' FROM customer WHERE c_mktsegment = 'BUILDING'),
z AS (SELECT DISTINCT {ID}, * FROM s)"""


@query("mapping_backfill", BACKFILL + " SELECT * FROM z")
def mapping_backfill(spark, sf):
    """Mappings from tag matches, people's decisions, local tables, applied reviews and exclusions, one of each id."""
    p = table(spark, sf, "part")
    item = F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("item")
    catalog = p.select(item, F.replace("p_name", F.lit(" "), F.lit(" ; ")).alias("matched"))
    state = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'candidate' WHEN 3 THEN 'separate' ELSE 'unmapped' END")
    decided = p.select(item, state.alias("mapping_status"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("field"))
    audit = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("heading"), F.col("o_orderpriority").alias("field_id"), F.col("o_custkey").alias("entity"))
    resolved = first_rows(spark, sf).select(*CELL, F.expr(DECISION).alias("decision"), F.expr(APPLIED).alias("applied_status"), F.col("k").alias("document"))
    out = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"), F.lit("total").alias("field_id"), F.when(F.col("c_custkey") % 2 == 0, 1995).alias("from_year"), F.lit(None).cast("int").alias("to_year"))
    g = governance
    parts = [g.mappings_from_catalog(catalog), g.mappings_from_decisions(decided), g.mappings_from_local_rows(audit), g.mappings_from_reviews(resolved), g.mappings_from_exclusions(out)]
    return g.backfill([*parts, parts[1]])


@query("model_proposals_checked", """
WITH d AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'i' || c_custkey END AS item, CASE c_custkey % 5 WHEN 0 THEN 'map' WHEN 1 THEN 'new_concept' WHEN 2 THEN 'different_scope' WHEN 3 THEN 'ignore' ELSE 'guess' END AS action, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'c' || c_nationkey END AS concept, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'because' END AS rationale FROM customer)
SELECT c_custkey, 'proposed' AS status, 'model:small' AS decided_by, 'map_' || left(sha1(item || '|' || concept || '|' || action || '|model:small'), 16) AS mapping,
  CASE WHEN trim(item) = '' THEN 'item_required' WHEN action = 'guess' THEN 'invalid_action' WHEN rationale = '' THEN 'rationale_required' WHEN action IN ('map', 'different_scope') AND concept = '' THEN 'concept_required' WHEN action = 'new_concept' AND name IS NULL THEN 'name_required' END AS refused FROM d""")
def model_proposals_checked(spark, sf):
    k = F.col("c_custkey")
    action = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'map' WHEN 1 THEN 'new_concept' WHEN 2 THEN 'different_scope' WHEN 3 THEN 'ignore' ELSE 'guess' END")
    decisions = table(spark, sf, "customer").select("c_custkey", F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("i"), k.cast("string"))).alias("item"), action.alias("action"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))).alias("concept"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 7 == 0, "").otherwise("because").alias("rationale"), F.lit("small").alias("model"))
    return governance.checked_proposals(decisions).select("c_custkey", "status", "decided_by", "mapping", "refused")


@query("confirmable_proposals", ROWS + ", m AS (SELECT o_orderpriority AS concept FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 3 = 0) SELECT count(*) AS proposals, count(*) FILTER (concept IN (SELECT field_id FROM q WHERE state = 'P')) AS likely_confirmable FROM m")
def confirmable_proposals(spark, sf):
    o = table(spark, sf, "orders")
    mappings = o.select(F.col("o_orderpriority").alias("concept"), F.when(F.col("o_orderkey") % 2 == 0, "proposed").otherwise("confirmed").alias("status"), F.when(F.col("o_custkey") % 3 == 0, "model:a").otherwise("person").alias("decided_by"))
    resolutions = first_rows(spark, sf).select("field_id", F.when(F.col("state") == "P", "auto_confirmed").otherwise("needs_review").alias("resolution"))
    return governance.confirmable(mappings, resolutions)


CONCEPTS = "SELECT n_name AS concept, lower(n_name) AS name, 'r' || n_regionkey AS category, 'u' AS unit, CASE WHEN n_nationkey % 5 = 0 THEN 'retired' ELSE 'active' END AS status FROM nation"


def concepts(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("concept"), F.lower("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("category"), F.lit("u").alias("unit"), F.when(F.col("n_nationkey") % 5 == 0, "retired").otherwise("active").alias("status"))


@query("concept_split", f"WITH c AS ({CONCEPTS}) SELECT * FROM c UNION ALL SELECT 'new', 'n', category, unit, 'active' FROM c WHERE concept = 'NATION_1' UNION ALL SELECT 'split_' || left(sha1('NATION_2|other'), 16), 'other', category, unit, 'active' FROM c WHERE concept = 'NATION_2'")
def concept_split(spark, sf):
    """A part with an id, one without, one whose id exists, and one of an unknown source."""
    parts = spark.createDataFrame([("NATION_1", "new", "n"), ("NATION_2", "", "other"), ("NATION_2", "NATION_3", "x"), ("NOWHERE", "y", "y")], "source string, concept string, name string")
    return governance.split_concept(concepts(spark, sf), parts)


@query("concept_update", f"WITH c AS ({CONCEPTS}) SELECT concept, CASE concept WHEN 'NATION_1' THEN 'renamed' ELSE name END AS name, category, unit, CASE concept WHEN 'NATION_4' THEN 'merged' ELSE status END AS status FROM c")
def concept_update(spark, sf):
    """A new name, a new state, and an unknown state, which changes nothing."""
    updates = spark.createDataFrame([("NATION_1", "renamed", None, None), ("NATION_4", None, None, "merged"), ("NATION_6", "lost", None, "gone")], "concept string, name string, category string, status string")
    return governance.update_concepts(concepts(spark, sf), updates)


@query("concept_list_page", f"WITH c AS ({CONCEPTS}) SELECT concept, status FROM c WHERE contains(lower(concept || ' ' || name || ' ' || category), 'nation_1') ORDER BY status, category, concept LIMIT 5 OFFSET 5")
def concept_list_page(spark, sf):
    found = paging.search(concepts(spark, sf).select("concept", "name", "category", "status"), "Nation_1")
    return paging.page(found, ["status", "category", "concept"], 2, 5).select("concept", "status")


@query("concept_status_counts", f"WITH c AS ({CONCEPTS}) SELECT status, count(*) AS rows FROM c GROUP BY 1")
def concept_status_counts(spark, sf):
    return paging.facet(concepts(spark, sf), "status")


def fact_rows(spark, sf):
    """Line items with the brand of their part as element."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("x:"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("element"), "p_name")
    l = table(spark, sf, "lineitem").join(p, "l_partkey")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "element", F.concat("l_returnflag", F.lit("Year"), "l_linestatus").alias("context"), F.col("l_returnflag").alias("relative_year"), F.col("l_linestatus").alias("scope"), F.col("p_name").alias("value"), F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), "element").alias("id"))


FACTS = "WITH f AS (SELECT l_orderkey, l_linenumber, 'x:' || replace(p_brand, '#', '') AS element, l_returnflag || 'Year' || l_linestatus AS context, l_returnflag AS relative_year, l_linestatus AS scope, p_name AS value, l_linenumber || '/x:' || replace(p_brand, '#', '') AS id FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("facts_by_element_list", FACTS + " SELECT l_orderkey, l_linenumber FROM f WHERE element IN (SELECT 'x:' || replace(p_brand, '#', '') FROM part WHERE p_size < 5) AND relative_year = 'N' AND scope IN ('O')")
def facts_by_element_list(spark, sf):
    wanted = table(spark, sf, "part").where("p_size < 5").select(F.concat(F.lit("x:"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("element"))
    return governance.facts(fact_rows(spark, sf), wanted, "N", ["O"]).select("l_orderkey", "l_linenumber")


@query("facts_by_text", FACTS + " SELECT l_orderkey, l_linenumber FROM f WHERE starts_with(context, 'RYear') AND contains(value, 'ring') AND (contains(value, 'bolt') OR contains(value, 'e'))")
def facts_by_text(spark, sf):
    return governance.facts(fact_rows(spark, sf), prefix="RYear", holds=("ring",), any_of=("bolt", "e")).select("l_orderkey", "l_linenumber")


@query("preferred_text_block", FACTS + " SELECT l_orderkey, l_linenumber, element FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE element WHEN 'x:Brand3' THEN 0 WHEN 'x:Brand1' THEN 1 ELSE 2 END, id) = 1")
def preferred_text_block(spark, sf):
    return governance.preferred_block(fact_rows(spark, sf), ["l_orderkey"], ["Brand3", "Brand1"]).select("l_orderkey", "l_linenumber", "element")


@query("call_budget", "SELECT count(*) AS calls, count(*) < 300 AS allowed FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def call_budget(spark, sf):
    calls = table(spark, sf, "events").select(F.col("ts").cast("timestamp_ntz").alias("at"))
    return governance.calls_since(calls, F.lit("2024-01-10").cast("timestamp_ntz"), 300)


@query("shadow_regression", ROWS + " SELECT entity, year, field_id, CASE WHEN k % 4 = 0 THEN 'missing' WHEN k % 4 = 1 THEN 'mismatch' ELSE 'reproduced' END AS outcome FROM q")
def shadow_regression(spark, sf):
    """A second run that lost one cell in four, moved one by a hundredth, and rounded the others."""
    q, k, price = first_rows(spark, sf), F.col("k"), F.col("price")
    golden = q.select(*CELL, price.alias("value"))
    again = q.where("k % 4 <> 0").select(*CELL, F.when(k % 4 == 1, price * 1.01 + 2).otherwise(F.round(price)).alias("value"))
    return governance.shadow(golden, again, CELL).select(*CELL, "outcome")


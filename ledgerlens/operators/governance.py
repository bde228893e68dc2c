"""Audits of the published tables and of the definitions behind them, and the mapping store's backfill from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, nullify_blank, stable_id, within
from .actions import CELL, DECISIONS, DONE
from .merge import first_wins

#: Severity of each finding of consistency().
SEVERITY = {
    "review_resolved_duplicate_keys": "P1", "invalid_review_decision": "P1", "applied_review_missing_final": "P0", "applied_review_value_mismatch": "P1",
    "not_applicable_review_present_in_final": "P1", "rejected_review_present_in_final": "P1", "final_value_missing_source_audit": "P1", "source_audit_without_final_value": "P2",
    "final_long_missing_wide_row": "P1", "final_long_wide_value_mismatch": "P1", "final_duplicate_top_score_ambiguous": "P2", "final_master_long_duplicate_keys_observed": "info",
    "cell_detail_review_state_mismatch": "P1", "semantics_csv_mirror_stale": "P2",
}


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers within 1e-6, or as texts; blanks are equal."""
    x, y = nullify_blank(a), nullify_blank(b)
    n, m = finite(x), finite(y)
    return F.when(x.isNull() & y.isNull(), True).when(n.isNotNull() & m.isNotNull(), F.abs(n - m) <= 1e-6).otherwise(x.eqNullSafe(y))


def consistency(final: DataFrame, resolved: DataFrame, audit: DataFrame, wide: DataFrame, detail: DataFrame, mirrors: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(finding, severity, rows): what the published tables say against each other.

    final (cell, value, score, ordinal): rows of the long table, of a cell the last by ordinal counts for reviews and the
    best by score for the wide table; resolved (cell, decision, corrected_value, applied_status, applied_value); audit
    (cell); wide (cell, value): the wide table unpivoted, a row for every cell of a row it has; detail (cell, saved,
    applied_status): what the cell view shows; mirrors (table, rows, mirror_rows). Values are texts.
    """
    found = []

    def note(name: str, df: DataFrame) -> None:
        found.append(df.select(F.lit(name).alias("finding")))

    note("review_resolved_duplicate_keys", resolved.groupBy(*CELL).count().where("count > 1"))
    note("invalid_review_decision", resolved.where(~F.coalesce(F.lower(F.trim("decision")).isin(*DECISIONS), F.lit(False))))
    has = ~F.isnull(nullify_blank(F.col("value")))
    per_cell = final.groupBy(*CELL).agg(F.max_by("value", ordinal).alias("final_value"), F.bool_or(has).alias("valued"), F.count("*").alias("n"))
    joined = resolved.withColumn("status", F.lower(F.trim(F.coalesce("applied_status", F.lit(""))))).join(per_cell.withColumn("_f", F.lit(True)), CELL, "left")
    there = F.col("_f").isNotNull()
    expected = F.when(F.lower("decision") == "correct", F.col("corrected_value"))
    blank_or_same = lambda c: F.isnull(nullify_blank(c)) | same_value(c, F.col("final_value"))
    applied, shown = F.col("status") == "applied", F.isnotnull(nullify_blank(F.col("final_value")))
    note("applied_review_missing_final", joined.where(applied & ~there))
    note("applied_review_value_mismatch", joined.where(applied & there & ~(blank_or_same(expected) & blank_or_same(F.col("applied_value")))))
    note("not_applicable_review_present_in_final", joined.where(((F.col("status") == "not_applicable") & shown) | (applied & there & (F.lower("decision") == "not_applicable"))))
    note("rejected_review_present_in_final", joined.where((F.col("status") == "rejected") & shown))
    keys = audit.select(*CELL).distinct()
    valued = per_cell.where("valued").select(*CELL)
    note("final_value_missing_source_audit", valued.join(keys, CELL, "left_anti"))
    note("source_audit_without_final_value", keys.join(valued, CELL, "left_anti"))
    best = final.groupBy(*CELL).agg(F.max_by("value", F.struct("score", ordinal)).alias("expected"))
    rows = wide.select("entity", "year").distinct().withColumn("_w", F.lit(True))
    both = best.join(wide.select(*CELL, F.col("value").alias("stored"), F.lit(True).alias("_c")), CELL, "left").join(rows, ["entity", "year"], "left")
    note("final_long_missing_wide_row", both.where("_w IS NULL").select("entity", "year").distinct())
    note("final_long_wide_value_mismatch", both.where(F.col("_c").isNotNull() & ~same_value(F.col("expected"), F.col("stored"))))
    top = final.where(has).groupBy(*CELL, "score").agg(F.count_distinct("value").alias("values")).groupBy(*CELL).agg(F.max_by("values", "score").alias("values"))
    note("final_duplicate_top_score_ambiguous", top.where("values > 1"))
    note("final_master_long_duplicate_keys_observed", per_cell.where("n > 1"))
    view = resolved.join(detail.select(*CELL, "saved", F.col("applied_status").alias("_shown")), CELL, "left")
    note("cell_detail_review_state_mismatch", view.where(~F.coalesce("saved", F.lit(False)) | ~F.coalesce("_shown", F.lit("")).eqNullSafe(F.coalesce("applied_status", F.lit("")))))
    note("semantics_csv_mirror_stale", mirrors.where("rows <> mirror_rows"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return out.groupBy("finding").agg(F.count("*").alias("rows")).select("finding", severity[F.col("finding")].alias("severity"), "rows")


def overall(findings: DataFrame) -> DataFrame:
    """One row: status (needs_attention if there is a P0 or P1), their number and that of all findings."""
    grave = F.count_if(F.col("severity").isin("P0", "P1"))
    return findings.agg(F.when(grave > 0, "needs_attention").otherwise("pass").alias("status"), grave.alias("p0_p1"), F.count("*").alias("findings"))


def saved_not_applied(resolved: DataFrame) -> DataFrame:
    return resolved.where(~F.coalesce(F.lower(F.trim("applied_status")).isin(*DONE), F.lit(False)))


def definition_findings(fields: DataFrame, final: DataFrame, concepts: DataFrame, mappings: DataFrame, sections: DataFrame, low: int = 5, many: int = 10) -> DataFrame:
    """(kind, severity, target, detail): duplicate tags, contradictory mappings, rarely filled fields, orphan and unconfirmed concepts, and sections left over from reviews, with a summary.

    fields (field_id, tags, scope, filters: arrays of texts), final (field_id, value), concepts (concept), mappings (item,
    concept, status), sections (section, targets, headings: arrays).
    """
    marks = F.array_intersect("filters", F.array(F.lit("ConsolidatedMember"), F.lit("NonConsolidatedMember")))
    tagged = fields.select("field_id", "scope", marks.alias("marks"), F.explode(F.array_distinct("tags")).alias("tag")).where("tag <> ''")
    shared = tagged.groupBy("tag").agg(F.array_sort(F.collect_set("field_id")).alias("ids"), F.array_sort(F.collect_set("scope")).alias("scopes"), F.collect_list("marks").alias("m")).where(F.size("ids") >= 2)
    apart = (F.size("ids") == 2) & (F.col("scopes") == F.array(F.lit("consolidated"), F.lit("standalone")))
    apart = apart & F.forall("m", lambda x: F.size(x) > 0) & ~F.arrays_overlap(F.get("m", F.lit(0)), F.get("m", F.lit(1)))
    duplicate = shared.select(F.lit("duplicate_tag").alias("kind"), F.when(apart, "low").otherwise("medium").alias("severity"), F.col("tag").alias("target"), F.array_join("ids", ",").alias("detail"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    sure = mappings.where(F.col("status") == "confirmed").where(some("concept"))
    split = sure.where(some("item")).groupBy("item").agg(F.array_sort(F.collect_set("concept")).alias("c")).where(F.size("c") > 1)
    contradictory = split.select(F.lit("contradictory_mapping").alias("kind"), F.lit("high").alias("severity"), F.col("item").alias("target"), F.array_join("c", ",").alias("detail"))
    filled = final.where(~F.isnull(nullify_blank(F.col("value")))).groupBy("field_id").agg(F.count("*").alias("n"))
    rare = fields.select("field_id").join(filled, "field_id", "left").where(F.coalesce("n", F.lit(0)) < low)
    rarely = rare.select(F.lit("low_coverage_concept").alias("kind"), F.when(F.col("n").isNull(), "info").otherwise("medium").alias("severity"), F.col("field_id").alias("target"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))
    confirmed = sure.select("concept").distinct()
    alone = concepts.select("concept").join(fields.select(F.col("field_id").alias("concept")), "concept", "left_anti").join(confirmed, "concept", "left_anti")
    orphan = alone.select(F.lit("orphan_concept").alias("kind"), F.lit("medium").alias("severity"), F.col("concept").alias("target"), F.lit("").alias("detail"))
    proposed = mappings.where("status = 'proposed'").where(some("concept")).groupBy("concept").agg(F.count("*").alias("n"))
    open_ = fields.select(F.col("field_id").alias("concept")).join(confirmed, "concept", "left_anti").join(proposed, "concept", "left")
    unconfirmed = open_.select(F.lit("unconfirmed_concept").alias("kind"), F.lit("low").alias("severity"), F.col("concept").alias("target"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))
    left = sections.where(F.col("section").startswith("review_"))
    debt = left.select(F.lit("review_section_debt").alias("kind"), F.lit("low").alias("severity"), F.col("section").alias("target"), F.array_join("targets", ",").alias("detail"))
    summary = sections.agg(F.count_if(F.col("section").startswith("review_")).alias("n"), F.count("*").alias("all"))
    summary = summary.select(F.lit("review_section_debt_summary").alias("kind"), F.when(F.col("n") >= many, "medium").otherwise("low").alias("severity"), F.lit("sections").alias("target"), F.concat_ws("/", F.col("n").cast("string"), F.col("all").cast("string")).alias("detail"))
    out = duplicate
    for df in (contradictory, rarely, orphan, unconfirmed, debt, summary):
        out = out.unionByName(df)
    return out.withColumn("finding_id", stable_id("finding", F.col("kind"), F.col("target"), F.col("detail")))


def risk_flags(fields: DataFrame, sections: DataFrame, resolved: DataFrame) -> DataFrame:
    """(severity, area, target, flag): large sections, rarely filled fields, fields with many candidates, local rules beside structured data, and saved reviews that are not applied.

    fields (field_id, coverage, synonyms, tags: counts, local_rows, preferred_method); sections (section, targets); resolved (cell, decision, applied_status).
    """
    flag = lambda df, severity, area, target, name: df.select(F.lit(severity).alias("severity"), F.lit(area).alias("area"), target.alias("target"), F.lit(name).alias("flag"))
    each = F.array_compact(F.array(
        F.when((F.col("coverage") > 0) & (F.col("coverage") < 0.75), F.struct(F.lit("medium").alias("s"), F.lit("field_coverage").alias("a"), F.lit("low_coverage").alias("f"))),
        F.when((F.col("synonyms") >= 8) | (F.col("tags") >= 8), F.struct(F.lit("low").alias("s"), F.lit("field_definition").alias("a"), F.lit("many_candidates").alias("f"))),
        F.when((F.col("local_rows") > 0) & (F.col("preferred_method") == "XBRL_CSV"), F.struct(F.lit("low").alias("s"), F.lit("field_method").alias("a"), F.lit("local_rule_supplements_xbrl_field").alias("f"))),
    ))
    of_fields = fields.select("field_id", F.explode(each).alias("x")).select(F.col("x.s").alias("severity"), F.col("x.a").alias("area"), F.col("field_id").alias("target"), F.col("x.f").alias("flag"))
    large = flag(sections.where(F.size("targets") >= 8), "low", "section_config", F.col("section"), "large_section_target_surface")
    unapplied = resolved.where(F.lower(F.trim("decision")).isin("accept", "correct") & (F.trim(F.coalesce("applied_status", F.lit(""))) != "applied"))
    name = F.concat(F.concat_ws("_", F.col("entity").cast("string"), F.col("year").cast("string")), F.lit(":"), F.col("field_id"))
    return of_fields.unionByName(large).unionByName(flag(unapplied, "high", "review_application", name, "saved_review_not_applied"))


MAPPING = ["mapping", "item", "concept", "action", "status", "decided_by", "scope"]


def _mapping(df: DataFrame, item: Column, concept: Column, action: Column, status: Column, by: str, scope: Column | None = None) -> DataFrame:
    none = F.lit("")
    rows = df.select(F.coalesce(item, none).alias("item"), F.coalesce(concept, none).alias("concept"), action.alias("action"), status.alias("status"), F.lit(by).alias("decided_by"), F.coalesce(none if scope is None else scope, none).alias("scope"))
    return rows.withColumn("mapping", stable_id("map", F.col("item"), F.col("concept"), F.col("action"), F.col("decided_by"), F.col("scope"))).select(*MAPPING)


def mappings_from_catalog(catalog: DataFrame) -> DataFrame:
    """Proposals from a catalog of found metrics (item, matched): one for each field that a metric's tags matched, parted by ;."""
    rows = catalog.select("item", F.explode(F.filter(F.transform(F.split(F.coalesce("matched", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("field"))
    return _mapping(rows, F.col("item"), F.col("field"), F.lit("map"), F.lit("proposed"), "rule:tag_match")


def mappings_from_decisions(decided: DataFrame) -> DataFrame:
    """Mappings from people's decisions on metrics (item, mapping_status, field): accepted, rejected, candidate or separate; others make none."""
    s, field = F.col("mapping_status"), F.nullif(F.trim(F.coalesce("field", F.lit(""))), F.lit(""))
    action = F.when((s == "accepted") & field.isNotNull(), "map").when(s == "rejected", "ignore").when(s == "candidate", "map").when(s == "separate", "different_scope")
    rows = decided.withColumn("_a", action).where("_a IS NOT NULL AND coalesce(item, '') <> ''")
    return _mapping(rows, F.col("item"), F.when(F.col("_a") != "ignore", field), F.col("_a"), F.when(s == "candidate", "proposed").otherwise("confirmed"), "person:field_mappings")


def mappings_from_local_rows(audit: DataFrame) -> DataFrame:
    """Confirmed mappings of local tables' rows (heading, field_id, entity): an item for each heading, field and entity."""
    rows = audit.select("heading", "field_id", "entity").distinct()
    return _mapping(rows, stable_id("local", F.col("heading"), F.col("field_id"), F.col("entity")), F.col("field_id"), F.lit("map"), F.lit("confirmed"), "rule:local_table")


def mappings_from_reviews(resolved: DataFrame) -> DataFrame:
    """Mappings from applied reviews (cell, decision, applied_status, document): accepted or corrected ones map, those out of scope are ignored for the entity."""
    d, a = F.col("decision"), F.col("applied_status")
    rows = resolved.withColumn("_a", F.when(d.isin("correct", "accept") & (a == "applied"), "map").when((d == "not_applicable") & (a == "not_applicable"), "ignore")).where("_a IS NOT NULL")
    item = stable_id("review", F.col("entity"), F.col("year"), F.col("field_id"), F.col("document"))
    ignored = F.col("_a") == "ignore"
    return _mapping(rows, item, F.when(~ignored, F.col("field_id")), F.col("_a"), F.lit("confirmed"), "person:review", F.when(ignored, F.col("entity").cast("string")))


def mappings_from_exclusions(exclusions: DataFrame) -> DataFrame:
    """Declarations that a field is out of scope for an entity (entity, field_id, from_year, to_year): mappings without an item."""
    rows = exclusions.where("entity IS NOT NULL AND field_id IS NOT NULL")
    return _mapping(rows, F.lit(""), F.col("field_id"), F.lit("ignore"), F.lit("confirmed"), "person:exclusions", F.concat_ws("|", F.col("entity").cast("string"), F.coalesce(F.col("from_year").cast("string"), F.lit("")), F.coalesce(F.col("to_year").cast("string"), F.lit(""))))


def backfill(sources: list[DataFrame]) -> DataFrame:
    """All mappings of the sources, one of each id, the first source's; a second run gives the same."""
    out = None
    for i, df in enumerate(sources):
        one = df.withColumn("_o", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return first_wins(out, ["mapping"], "_o").drop("_o")


def checked_proposals(decisions: DataFrame) -> DataFrame:
    """A model's decisions (item, action, concept, name, rationale, model) as proposals, with refused: what a decision lacks. A proposal is never confirmed here."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    a = F.col("action")
    why = (
        F.when(~some("item"), "item_required").when(~F.coalesce(a.isin("map", "new_concept", "different_scope", "ignore"), F.lit(False)), "invalid_action").when(~some("rationale"), "rationale_required")
        .when(a.isin("map", "different_scope") & ~some("concept"), "concept_required").when((a == "new_concept") & ~some("name"), "name_required")
    )
    by = F.concat(F.lit("model:"), "model")
    out = decisions.withColumn("refused", why).withColumn("status", F.lit("proposed")).withColumn("decided_by", by)
    return out.withColumn("mapping", stable_id("map", F.col("item"), F.col("concept"), a, by))


def confirmable(mappings: DataFrame, resolutions: DataFrame, machine: str = "model:") -> DataFrame:
    """One row: open proposals of models, and those whose concept has cells that evidence has confirmed."""
    open_ = mappings.where((F.col("status") == "proposed") & F.col("decided_by").startswith(machine))
    sure = resolutions.where("resolution = 'auto_confirmed'").select(F.col("field_id").alias("concept"), F.lit(True).alias("_c")).distinct()
    return open_.join(sure, "concept", "left").agg(F.count("*").alias("proposals"), F.count("_c").alias("likely_confirmable"))


def split_concept(concepts: DataFrame, parts: DataFrame) -> DataFrame:
    """concepts (concept, name, category, unit, status) with the new ones of parts (source, concept, name): category and unit are the source's; a part without an id gets one of its source and name; ids that exist are refused (left out)."""
    own = F.coalesce(F.nullif(F.trim(F.coalesce("concept", F.lit(""))), F.lit("")), stable_id("split", F.col("source"), F.col("name")))
    base = concepts.select(F.col("concept").alias("source"), "category", "unit")
    new = parts.withColumn("concept", own).join(base, "source").select("concept", "name", "category", "unit", F.lit("active").alias("status"))
    return concepts.unionByName(new.join(concepts.select("concept"), "concept", "left_anti"))


def update_concepts(concepts: DataFrame, updates: DataFrame, allowed: tuple[str, ...] = ("active", "merged", "retired")) -> DataFrame:
    """concepts with names, categories and states of updates (concept, name, category, status; null: as it is); an unknown state changes nothing."""
    u = updates.select("concept", *[F.col(c).alias(f"_{c}") for c in ("name", "category", "status")])
    ok = F.col("_status").isNull() | F.col("_status").isin(*allowed)
    out = concepts.join(u, "concept", "left")
    return out.select(*[F.coalesce(F.when(F.coalesce(ok, F.lit(True)), F.col(f"_{c}")), F.col(c)).alias(c) if c in ("name", "category", "status") else F.col(c) for c in concepts.columns])


def facts(df: DataFrame, elements: DataFrame | None = None, relative_year: str | None = None, scopes: list[str] | None = None, prefix: str | None = None, holds: tuple[str, ...] = (), any_of: tuple[str, ...] = ()) -> DataFrame:
    """Facts (element, context, relative_year, scope, value) of a list of elements, a relative year, scopes, contexts that begin with a prefix, and texts that hold all of some words and one of others. A list of any length is a semi-join."""
    if relative_year:
        df = df.where(F.col("relative_year") == relative_year)
    if scopes:
        df = df.where(F.col("scope").isin(*scopes))
    if prefix:
        df = df.where(F.col("context").startswith(prefix))
    for w in holds:
        df = df.where(F.col("value").contains(w))
    if any_of:
        hit = F.lit(False)
        for w in any_of:
            hit = hit | F.col("value").contains(w)
        df = df.where(hit)
    return df.join(elements.select("element").distinct(), "element", "left_semi") if elements is not None else df


def preferred_block(blocks: DataFrame, keys: list[str], suffixes: list[str]) -> DataFrame:
    """Of each key the block whose element ends in the first of the suffixes (after a colon), then the smallest id."""
    rank = F.lit(len(suffixes))
    for i, s in reversed(list(enumerate(suffixes))):
        rank = F.when(F.col("element").endswith(f":{s}"), i).otherwise(rank)
    return blocks.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in blocks.columns if c not in keys]), F.struct(rank, F.col("id"))).alias("b")).select(*keys, "b.*")


def calls_since(calls: DataFrame, start: Column, most: int) -> DataFrame:
    """One row: the calls of a log since a time, and whether the budget allows another."""
    return calls.where(F.col("at") >= start).agg(F.count("*").alias("calls")).withColumn("allowed", F.col("calls") < most)


def shadow(golden: DataFrame, rerun: DataFrame, keys: list[str]) -> DataFrame:
    """A regression run: golden values (keys, value, origin) against those of a second run of the pipeline into another place; one row a key of golden, with what became of it."""
    got = rerun.select(*keys, F.col("value").alias("again"))
    out = golden.join(got, keys, "left")
    same = F.coalesce(within(F.col("value") - F.col("again"), F.col("value"), 1.0, 0.001), F.lit(False))
    return out.withColumn("outcome", F.when(F.col("again").isNull(), "missing").when(same, "reproduced").otherwise("mismatch"))

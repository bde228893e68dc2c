"""What reviewers and inference do to cells: decisions, candidates, bulk actions, promotion to blank cells, gates.

Everything is set-based: a table of decisions, actions or choices comes in and a table of new review rows goes out, with a
column that says why a row was refused. A preview is the same table that would be written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import truthy, within
from .extract import top_per_group

CELL = ["entity", "year", "field_id"]
DECISIONS = ("accept", "correct", "reject", "not_applicable")
DONE = ("applied", "rejected", "not_applicable")


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def refusal(decision: Column, corrected: Column) -> Column:
    """Why a decision cannot be saved; null if it can."""
    return F.when(~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), "unknown_decision").when((decision == "correct") & _blank(corrected), "value_required")


def checked(decisions: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """decisions (keys, decision, corrected_value, ...) with refused: a key that lacks a part, an unknown decision, a correction without a value, or a key that is not in the queue."""
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    known = queue.select(*keys).distinct().withColumn("_q", F.lit(True))
    why = F.when(empty, "key_required").otherwise(F.coalesce(refusal(F.col("decision"), F.col("corrected_value")), F.when(F.col("_q").isNull(), "not_in_queue")))
    return decisions.join(known, keys, "left").withColumn("refused", why).drop("_q")


def upsert_reviews(resolved: DataFrame, queue: DataFrame, decisions: DataFrame, keys: list[str], fresh: list[str]) -> DataFrame:
    """resolved after the decisions that are not refused: their `fresh` columns come from the decision; all others from the row that is there, else from the queue's.

    Tables are unique by key; of several decisions on a key the caller keeps the last.
    """
    new = checked(decisions, queue, keys).where("refused IS NULL").select(*keys, *[F.col(c).alias(f"_n_{c}") for c in fresh], F.lit(True).alias("_new"))
    rest = [c for c in resolved.columns if c not in keys and c not in fresh]
    base = queue.select(*keys, *[F.col(c).alias(f"_q_{c}") for c in rest if c in queue.columns])
    out = resolved.withColumn("_old", F.lit(True)).join(new, keys, "full_outer").join(base, keys, "left")
    own = [F.when(F.col("_old").isNotNull(), F.col(c)).otherwise(F.col(f"_q_{c}") if c in queue.columns else F.lit(None)).alias(c) for c in rest]
    said = [F.when(F.col("_new").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fresh]
    return out.select(*keys, *own, *said).select(*resolved.columns)


def in_range(year: Column, start: Column, end: Column) -> Column:
    """Open ends are null; a row without a year is only in a range open at both."""
    inside = (start.isNull() | (year >= start)) & (end.isNull() | (year <= end))
    return F.when(year.isNull(), start.isNull() & end.isNull()).otherwise(inside)


def not_applicable(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions for the queued cells that actions (entity, field_id, from_year, to_year, note) declare out of scope."""
    hit = queue.select(*CELL).join(actions, ["entity", "field_id"]).where(in_range(F.col("year"), F.col("from_year"), F.col("to_year")))
    return hit.select(*CELL, F.lit("not_applicable").alias("decision"), F.lit(None).cast("string").alias("corrected_value"), "note")


def drop_stale(resolved: DataFrame, actions: DataFrame) -> DataFrame:
    """resolved without the not-applicable rows of an action's entity and field that its new range leaves out; an action a field."""
    ranges = actions.select("entity", "field_id", "from_year", "to_year", F.lit(True).alias("_a"))
    out = resolved.join(ranges, ["entity", "field_id"], "left")
    stale = F.col("_a").isNotNull() & (F.col("decision") == "not_applicable") & ~in_range(F.col("year"), F.col("from_year"), F.col("to_year"))
    return out.where(~F.coalesce(stale, F.lit(False))).select(*resolved.columns)


def mart_candidates(rows: DataFrame, order: str) -> DataFrame:
    """Rows (cell, dataset, value, status, ...) of an external mart that fill a missing value; each dataset and value once, the first by order."""
    return top_per_group(rows.where((F.col("status") == "missing_value") & ~_blank(F.col("value"))), [*CELL, "dataset", F.col("value").cast("string")], [F.col(order)], 1).drop("rank")


def candidates(sources: dict[str, DataFrame], keys: list[str], order: str, most: int = 20) -> DataFrame:
    """(keys, candidate_id, source, value): the first rows of each source by order, named source:index from 0. Blank values of audits have an index and no row."""
    out = None
    for name, df in sources.items():
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
        one = df.withColumn("_i", at).where(F.col("_i") < most)
        if name == "audit":
            one = one.where(~_blank(F.col("value")))
        one = one.select(*keys, F.concat(F.lit(f"{name}:"), F.col("_i").cast("string")).alias("candidate_id"), F.lit(name).alias("source"), F.col("value").cast("string").alias("value"), F.col("_i").alias("place"))
        out = one if out is None else out.unionByName(one)
    return out


def save_choices(choices: DataFrame, found: DataFrame, keys: list[str], order: tuple[str, ...] = ("review", "factbook", "audit")) -> DataFrame:
    """choices (keys, candidate_id, decision, corrected_value) with the source and value of the candidate they mean, the value they save, and refused.

    Without an id the first candidate of the first source that has one is meant. An accepted blank and a wrong id are refused.
    """
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)])
    best = found.groupBy(*keys).agg(F.min_by(F.struct("candidate_id", "source", "value"), F.struct(rank[F.col("source")], "place")).alias("_best"))
    named = found.select(*keys, "candidate_id", F.struct("candidate_id", "source", "value").alias("_named"))
    joined = choices.join(named, [*keys, "candidate_id"], "left").join(best, keys, "left")
    given = ~_blank(F.col("candidate_id"))
    chosen = F.when(given, F.col("_named")).otherwise(F.col("_best"))
    out = joined.withColumn("source", chosen["source"]).withColumn("candidate_value", chosen["value"])
    value = F.when(F.col("decision") == "correct", F.col("corrected_value")).when(F.col("decision") == "accept", F.col("candidate_value"))
    why = F.coalesce(refusal(F.col("decision"), F.col("corrected_value")), F.when(given & F.col("_named").isNull(), "candidate_not_found"), F.when((F.col("decision") == "accept") & _blank(F.col("candidate_value")), "value_required"))
    return out.withColumn("saved_value", value).withColumn("refused", why).drop("_named", "_best")


def synthetic_rows(cells: DataFrame, wide: DataFrame, fields: DataFrame, audit: DataFrame, order: str) -> DataFrame:
    """Review rows for cells that are in no queue: name and present value from the long final table `wide` (cell, name, value), the field's name and unit, and the first audit row of the cell."""
    first = audit.groupBy(*CELL).agg(F.min_by(F.struct("value", "unit"), order).alias("_a"))
    out = cells.select(*CELL).join(wide.select(*CELL, "name", F.col("value").alias("existing_value")), CELL, "left").join(fields.select("field_id", "field_name", "target_unit"), "field_id", "left").join(first, CELL, "left")
    return out.select(
        *CELL, F.coalesce("name", F.lit("")).alias("name"), F.coalesce("field_name", "field_id").alias("field_name"), "existing_value", F.col("_a.value").alias("extracted_value"),
        F.coalesce("_a.unit", "target_unit").alias("unit"), F.lit("cell_workbench_manual").alias("reason"),
    )


def against_existing(value: Column, existing: Column) -> Column:
    """(difference, pct) of a value against the existing one; null where a side is, or where the base is zero."""
    return F.struct((value - existing).alias("difference"), F.try_divide(value - existing, existing).alias("pct"))


def promotion_plan(inferred: DataFrame, existing: DataFrame) -> DataFrame:
    """inferred cells (cell, status, value) of high confidence with their place in the plan.

    A blank cell is promoted if its entity and field are inferred with high confidence in two years or more, else it stays a
    candidate. A cell with a value is never written: it is reported if its validation failed and it is off by more than max(1, 0.5 %).
    """
    sure = inferred.where("status = 'high_confidence' AND value IS NOT NULL")
    years = F.count("*").over(Window.partitionBy("entity", "field_id"))
    there = existing.select(*CELL, F.col("value").alias("existing_value"), "validation_status", F.lit(True).alias("_there"))
    out = sure.withColumn("years", years).join(there, CELL, "left")
    off = ~within(F.col("existing_value") - F.col("value"), F.col("value"), 1.0, 0.005)
    suspect = F.when((F.col("validation_status") == "fail") & F.col("existing_value").isNotNull() & off, "suspect_existing_value").otherwise("filled")
    plan = F.when(F.col("_there").isNotNull(), suspect).when(F.col("years") >= 2, "promote").otherwise("candidate_single_year")
    return out.withColumn("plan", plan).drop("_there")


def apply_plan(plan: DataFrame, resolved: DataFrame, note: Column) -> DataFrame:
    """Decisions of the promoted cells; those with a review row are skipped (refused: existing_review)."""
    saved = resolved.select(*CELL).distinct().withColumn("_r", F.lit(True))
    out = plan.where("plan = 'promote'").join(saved, CELL, "left")
    return out.select(*CELL, F.lit("correct").alias("decision"), F.col("value").cast("string").alias("corrected_value"), note.alias("note"), F.lit("source_inference").alias("reviewer"), F.when(F.col("_r").isNotNull(), "existing_review").alias("refused"))


def other_years(plan: DataFrame, wanted: DataFrame) -> DataFrame:
    """The promoted cells of the entity and field of each wanted cell, as targets of an expansion; no other entity is touched."""
    keys = wanted.select("entity", "field_id", F.col("year").alias("from_cell_year"))
    return plan.where("plan = 'promote'").join(keys, ["entity", "field_id"]).select(*CELL, "value", "from_cell_year")


def blank_years(cells: DataFrame) -> DataFrame:
    """cells (cell, value) with the number of other years in which their entity and field are blank."""
    blank = _blank(F.col("value")).cast("long")
    return cells.withColumn("blank_years", F.sum(blank).over(Window.partitionBy("entity", "field_id")) - blank)


def group_decisions(queue: DataFrame, groups: DataFrame, reason: str = "review_reason", prefix: str = "identity_group_mismatch") -> DataFrame:
    """Decisions for the queued rows whose reasons name one of the groups (group_id, decision, corrected_value, note); reasons are parted by ; or ,."""
    ids = F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), "[;,]"), lambda r: F.trim(r)), lambda r: r.startswith(prefix))
    named = queue.select(*CELL, F.explode(F.array_distinct(ids)).alias("group_id"))
    return named.join(groups, "group_id").select(*CELL, "group_id", "decision", "corrected_value", F.coalesce("note", F.concat(F.lit("reconciliation group decision: "), "group_id")).alias("note"))


def done(decision: Column, applied: Column) -> Column:
    return F.coalesce(applied.isin(*DONE), F.lit(False)) | F.coalesce(decision == "not_applicable", F.lit(False))


def gate_status(queue: DataFrame, resolved: DataFrame, keys: list[str], missing: list[str], ages: dict[str, float | None], limits: dict[str, float], mismatches: int = 0, most_active: int = 0, most_unapplied: int = 0) -> DataFrame:
    """One row: counts, whether the gate is open, and what blocks it: active items, saved ones that are not applied, missing outputs, reports that are missing (age null) or older than their limit in days, mismatches of the regression."""
    saved = resolved.select(*keys, "decision", "applied_status").withColumn("_r", F.lit(True))
    joined = queue.select(*keys).join(saved, keys, "left")
    ok = done(F.col("decision"), F.col("applied_status"))
    counts = joined.agg(F.count("*").alias("items"), F.count_if(F.col("_r").isNull() | ~ok).alias("active_items"), F.count_if(F.col("_r").isNotNull() & ~ok).alias("unapplied_items"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    why = [
        F.when(F.col("active_items") > most_active, say("active_review_items=", F.col("active_items").cast("string"), f" exceeds {most_active}")),
        F.when(F.col("unapplied_items") > most_unapplied, say("saved_unapplied_reviews=", F.col("unapplied_items").cast("string"), f" exceeds {most_unapplied}")),
    ]
    if missing:
        why.append(F.lit("missing_final_outputs=" + ",".join(missing)))
    for name, limit in limits.items():
        age = ages.get(name)
        if age is None:
            why.append(F.lit(f"{name}_missing"))
        elif 0 < limit < age:
            why.append(F.lit(f"{name}_stale={round(age, 1)}d exceeds {limit:g}d"))
        elif name == "regression" and mismatches:
            why.append(F.lit(f"regression_mismatch_count={mismatches}"))
    out = counts.withColumn("blocking", F.array_compact(F.array(*why)))
    return out.withColumn("ready", F.size("blocking") == 0)


def cell_meta(rows: DataFrame, order: str) -> DataFrame:
    """One row a cell of rows (cell, value, method, status): whether any has a value, the last value with its method, the last status that is said."""
    has = F.col("value").isNotNull()
    last = lambda c, when: F.max_by(F.col(c), F.when(when, F.col(order)))
    method = F.max_by("method", F.when(has & ~_blank(F.col("method")), F.col(order)))
    return rows.groupBy(*CELL).agg(F.bool_or(has).alias("has_value"), F.when(F.bool_or(has), last("value", has)).alias("value"), F.when(F.bool_or(has & ~_blank(F.col("method"))), method).alias("method"), F.when(F.bool_or(~_blank(F.col("status"))), last("status", ~_blank(F.col("status")))).alias("status"))


def cell_rows(rows: DataFrame, order: str) -> DataFrame:
    """One row a cell: the first value, all methods in order, whether any row needs a review."""
    methods = F.array_join(F.array_sort(F.collect_set(F.when(~_blank(F.col("method")), F.col("method")))), ";")
    return rows.groupBy(*CELL).agg(F.min_by("value", order).alias("value"), methods.alias("methods"), F.bool_or(truthy(F.col("review_required"))).alias("review_required"))


def write_back(rows: DataFrame, resolutions: DataFrame) -> DataFrame:
    """rows with counts, status and references of their cell's resolution; zero and empty without one."""
    found = resolutions.select(*CELL, "corroboration_count", "conflict_count", F.col("resolution").alias("corroboration_status"), F.array_join("sources", ";").alias("corroboration_refs"))
    out = rows.join(found, CELL, "left")
    return out.na.fill({"corroboration_count": 0, "conflict_count": 0, "corroboration_status": "", "corroboration_refs": ""})


def overlays(state: Column, resolution: Column, weak: Column, mart: Column) -> Column:
    """A cell's state after evidence: a present value may be in conflict or unproven, weakly backed, and a blank one may have a candidate in an external mart."""
    proven = F.when((state == "value_present") & resolution.isin("conflicted", "needs_review", "needs_reconciliation"), F.concat(F.lit("corroboration_"), resolution)).otherwise(state)
    backed = F.when(weak & proven.isin("value_present", "value_present_no_audit", "corroboration_needs_review"), "corroboration_weak").otherwise(proven)
    return F.when(mart & backed.isin("blank_no_candidate", "blank_review_needs_rule", "blank_with_source_audit"), "factbook_candidate").otherwise(backed)


def zero_corroboration(cells: DataFrame) -> DataFrame:
    """Cells of a summary without any evidence, for or against, that no review is asked for."""
    return cells.where(~truthy(F.col("review_required")) & (F.coalesce("corroboration_count", F.lit(0)) == 0) & (F.coalesce("conflict_count", F.lit(0)) == 0))


def review_state(cells: DataFrame, queue: DataFrame, resolved: DataFrame, mart: DataFrame) -> DataFrame:
    """cells (cell, value) with saved, saved_not_applied, candidate_count, final_value_present and the actions that are open for it."""
    count = lambda df, name: df.groupBy(*CELL).agg(F.count("*").alias(name))
    held = queue.groupBy(*CELL).agg(F.count("*").alias("_q"), F.bool_or(~_blank(F.col("value"))).alias("_valued"))
    saved = resolved.select(*CELL, "applied_status", F.lit(True).alias("_s"))
    out = cells.join(held, CELL, "left").join(count(mart, "_m"), CELL, "left").join(saved, CELL, "left")
    q, m, is_saved = F.coalesce("_q", F.lit(0)), F.coalesce("_m", F.lit(0)), F.col("_s").isNotNull()
    applied = F.coalesce(F.lower(F.trim("applied_status")).isin(*DONE), F.lit(False))
    return out.select(
        *cells.columns, is_saved.alias("saved"), (is_saved & ~applied).alias("saved_not_applied"), (q + m).alias("candidate_count"), (~_blank(F.col("value"))).alias("final_value_present"),
        (F.coalesce("_valued", F.lit(False)) | (m > 0)).alias("can_accept"), ((q > 0) | is_saved).alias("can_reject"), (is_saved & _blank(F.col("value"))).alias("apply_needed"),
    )


def with_names(rows: DataFrame, names: DataFrame, key: str, name: str = "name") -> DataFrame:
    """rows with the name of their key; what a row has stays. names is unique by key."""
    known = names.select(F.col(key).alias("_k"), F.col(name).alias("_n"))
    own = F.nullif(F.trim(F.col(name)), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
    return rows.join(known, F.col(key) == F.col("_k"), "left").withColumn(name, F.coalesce(own, "_n", F.lit(""))).drop("_k", "_n")


def imported_notes(notes: DataFrame, aliases: DataFrame, years: DataFrame) -> DataFrame:
    """notes (name, period struct(year, month), ...) with the entity and fiscal year they speak of, or refused: period_unparsed, company_unmatched, year_unmatched.

    aliases (alias, entity, month): normalised names, unique, with the month in which the entity's year ends, which stands
    in where a note says no month. years (entity, end_year, end_month, year).
    """
    from ..functions.parsing import company_name

    named = notes.withColumn("_alias", company_name(F.col("name"))).join(aliases.select(F.col("alias").alias("_alias"), "entity", F.col("month").alias("_month")), "_alias", "left")
    named = named.withColumn("end_year", F.col("period.year")).withColumn("end_month", F.coalesce("period.month", "_month"))
    out = named.join(years, ["entity", "end_year", "end_month"], "left")
    why = F.when(F.col("period").isNull(), "period_unparsed").when(F.col("entity").isNull(), "company_unmatched").when(F.col("year").isNull(), "year_unmatched")
    return out.withColumn("refused", why).drop("_alias", "_month")


def run_counters(targets: DataFrame, rows: DataFrame, results: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of counters of a run: targets, resolved ones, transitions, rows, rows without a value, failed checks, items to review."""
    one = targets.agg(F.count("*").alias("targets"), F.count_if(F.col("resolution_status") == "resolved").alias("resolved"), F.count_if(F.coalesce("transition", F.lit(False))).alias("transitions"))
    two = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"))
    # Each side is one row.
    return one.join(F.broadcast(two)).join(F.broadcast(results.agg(F.count_if(F.col("status") == "fail").alias("failed_checks")))).join(F.broadcast(queue.agg(F.count("*").alias("to_review"))))


def read_run_report(lines: DataFrame, text: str = "value") -> DataFrame:
    """(kind, key, value): the summary of a run report in Markdown (- key: value) and its table of failed documents (| key | reason |)."""
    t = F.trim(F.col(text))
    item, row = "^- ([^:]+): (.*)$", "^\\|\\s*([^|]+?)\\s*\\|\\s*([^|]*?)\\s*\\|$"
    kind = F.when(t.rlike(item), "summary").when(t.rlike(row) & ~t.rlike("^\\|[\\s|:\\-]+$") & ~t.contains("failure_reason"), "failure")
    pick = lambda g: F.when(t.rlike(item), F.regexp_extract(t, item, g)).otherwise(F.regexp_extract(t, row, g))
    return lines.select(kind.alias("kind"), pick(1).alias("key"), pick(2).alias("value")).where("kind IS NOT NULL")

"""Review queue and decisions: reasons, demotion by evidence, application, categories and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import truthy, within

CELL = ["entity", "year", "field_id"]


def reasons(required: Column, stated: Column, confidence: Column, threshold: Column, scope: Column, wanted_scope: Column, unit: Column, value: Column, status: Column, human: Column, existing: Column) -> Column:
    """Ordered distinct reasons for review."""
    far = ~within(existing - value, existing, 10.0, 0.01)
    built = F.array(
        F.when(truthy(required), F.coalesce(F.nullif(stated, F.lit("")), F.lit("review_required"))),
        F.when((F.coalesce(threshold, F.lit(0.0)) > 0) & (F.coalesce(confidence, F.lit(0.0)) < threshold), "confidence_below_threshold"),
        F.when((F.coalesce(scope, F.lit("")) != "") & ~scope.eqNullSafe(wanted_scope), "data_scope_mismatch"),
        F.when((F.coalesce(unit, F.lit("")) == "") & value.isNotNull(), "unit_unknown"),
        F.when(status.isin("warn", "fail"), F.concat(F.lit("validation_"), status)),
        F.when(human.isin("approved", "corrected"), "existing_human_reviewed"),
        F.when(far, "existing_value_mismatch"),
    )
    return F.array_distinct(F.filter(F.flatten(F.transform(F.array_compact(built), lambda r: F.split(r, ";"))), lambda r: r != ""))


DEMOTABLE = ("confidence_below_threshold", "review_required")
FORCED = {"conflicted": "corroboration_conflict", "needs_review": "corroboration_needs_review", "needs_reconciliation": "corroboration_needs_reconciliation"}


def demote(why: Column, resolution: Column) -> Column:
    """Reasons after evidence: conflicts force one; a confirmed cell loses the demotable ones unless validation objects."""
    forced = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORCED.items() for x in kv]), resolution), F.lit(""))
    blocked = F.exists(why, lambda r: r.startswith("validation_"))
    lighter = F.filter(why, lambda r: ~r.isin(*DEMOTABLE))
    return F.when(forced != "", F.array_distinct(F.concat(why, F.array(forced)))).when((resolution == "auto_confirmed") & ~blocked, lighter).otherwise(why)


def apply_decisions(rows: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, value, review_required) with the saved decisions (keys, decision, corrected_value): full outer, so decisions without a row appear.

    accept takes the corrected value if there is one; blank review fields never overwrite.
    """
    joined = rows.withColumn("_row", F.lit(True)).join(decisions.withColumn("_saved", F.lit(True)), keys, "full_outer")
    status = (
        F.when(F.col("decision") == "reject", "rejected")
        .when(F.col("decision") == "not_applicable", "not_applicable")
        .when((F.col("decision") == "correct") & F.col("corrected_value").isNotNull(), "corrected")
        .when(F.col("decision") == "accept", "approved")
        .when(truthy(F.col("review_required")), "unreviewed")
        .otherwise("auto_accepted")
    )
    value = F.when(F.col("decision").isin("accept", "correct"), F.coalesce("corrected_value", "value")).otherwise(F.col("value"))
    out = joined.withColumn("status", status).withColumn("final_value", value)
    exported = F.col("status").isin("approved", "corrected", "auto_accepted") & F.col("final_value").isNotNull()
    origin = F.when(F.col("_row").isNull(), "review_only").when(F.col("_saved").isNull(), "extracted").otherwise("reviewed")
    return out.withColumn("exported", exported).withColumn("origin", origin).drop("_row", "_saved")


def applied_status(decisions: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """What became of each decision in the final table (keys, status, exported)."""
    found = decisions.select(*keys, "decision").join(final.select(*keys, "exported").withColumn("_f", F.lit(True)), keys, "left")
    status = F.when(F.col("decision") == "not_applicable", "not_applicable").when(F.col("decision") == "reject", "rejected").when(F.col("_f").isNull(), "not_found").when(F.col("exported"), "applied").otherwise("not_exported")
    return found.withColumn("applied_status", status).drop("_f")


def category(saved: Column, applied: Column, decision: Column, value: Column, why: Column) -> Column:
    """The first category of the ladder that fits."""
    done = saved & (applied.isin("applied", "rejected", "not_applicable") | (decision == "not_applicable"))
    has = lambda *names: F.arrays_overlap(why, F.array(*map(F.lit, names)))
    return (
        F.when(F.coalesce(done, F.lit(False)), "resolved_done")
        .when(saved, "saved_unapplied")
        .when(value.isNull(), "missing")
        .when(has("existing_human_reviewed", "existing_value_mismatch"), "recurrent")
        .when(has("validation_warn", "validation_fail"), "validation_issue")
        .when(has("data_scope_mismatch"), "scope_warning")
        .when(has("confidence_below_threshold", "unit_unknown"), "warning_candidate")
        .otherwise("new_candidate")
    )


def cell_state(found: Column, value: Column, audited: Column, failure: Column, decision: Column, reviewed: Column, candidate: Column) -> Column:
    """The state of a cell of the wide table."""
    return (
        F.when(~found, "row_not_found")
        .when(value.isNotNull() & audited, "value_present")
        .when(value.isNotNull(), "value_present_no_audit")
        .when(failure.isNotNull(), "document_failed")
        .when(decision == "not_applicable", "not_applicable")
        .when(reviewed.isNotNull(), "review_saved_not_applied")
        .when(candidate.isNotNull(), "blank_with_review_candidate")
        .when(audited, "blank_with_source_audit")
        .otherwise("blank_no_candidate")
    )


def gate(queue: DataFrame, decisions: DataFrame, keys: list[str], most_active: int = 0) -> DataFrame:
    """One row: items, active items (no decision), and whether the gate is open."""
    joined = queue.select(*keys).join(decisions.select(*keys, "decision"), keys, "left")
    counts = joined.agg(F.count("*").alias("items"), F.count_if(F.col("decision").isNull()).alias("active_items"))
    return counts.withColumn("ready", F.col("active_items") <= most_active)

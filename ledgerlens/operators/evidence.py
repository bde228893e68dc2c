"""Evidence that independent sources agree, and the resolution of each cell.

A cell is (entity, year, field_id). Evidence rows carry check_kind, check_ref, matched, primary_value, other_value,
difference, restatement_suspected and the two methods compared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import evidence_match, supports

CELL = ["entity", "year", "field_id"]
EVIDENCE = [*CELL, "check_kind", "check_ref", "matched", "primary_value", "other_value", "difference", "restatement_suspected", "method_a", "method_b"]


def _evidence(df: DataFrame, kind: str, ref: Column, matched: Column, a: Column, b: Column, restated: Column, method_a: Column, method_b: Column) -> DataFrame:
    return df.select(
        *CELL, F.lit(kind).alias("check_kind"), ref.cast("string").alias("check_ref"), matched.alias("matched"), a.cast("double").alias("primary_value"), b.cast("double").alias("other_value"),
        (a - b).cast("double").alias("difference"), restated.alias("restatement_suspected"), method_a.cast("string").alias("method_a"), method_b.cast("string").alias("method_b"),
    )


def same_cell(rows: DataFrame, absolute: float = 1.0, share: float = 0.001) -> DataFrame:
    """Pairs of rows of one cell with different methods and the same unit; null values give none.

    rows: CELL, method, unit, value. A cell has one value for each method of few, so pairs stay few.
    """
    rows = rows.where("value IS NOT NULL AND NOT isnan(value)")
    left = rows.select(*CELL, F.col("method").alias("ma"), F.col("unit").alias("ua"), F.col("value").alias("va"))
    right = rows.select(*CELL, F.col("method").alias("mb"), F.col("unit").alias("ub"), F.col("value").alias("vb"))
    pairs = left.join(right, CELL).where("ma < mb AND ua <=> ub")
    ref = F.concat_ws("|", "ma", "mb")
    return _evidence(pairs, "xbrl_vs_local", ref, evidence_match(F.col("va"), F.col("vb"), absolute, share), F.col("va"), F.col("vb"), F.lit(False), F.col("ma"), F.col("mb"))


def next_year_prior(current: DataFrame, prior: DataFrame, absolute: float = 1.0, share: float = 0.001) -> DataFrame:
    """A year's value against what the next year states as its prior one; a mismatch is always a suspected restatement."""
    stated = prior.select("entity", (F.col("year") - 1).alias("year"), "field_id", F.col("value").alias("vb"))
    pairs = current.withColumnRenamed("value", "va").join(stated, CELL).where("va IS NOT NULL AND vb IS NOT NULL")
    matched = evidence_match(F.col("va"), F.col("vb"), absolute, share)
    return _evidence(pairs, "next_year_prior", F.col("year") + 1, matched, F.col("va"), F.col("vb"), ~matched, F.lit(None), F.lit(None))


def from_rules(results: DataFrame) -> DataFrame:
    """Evidence from rule results: a pass is a match, a fail a conflict, the others are none."""
    rows = results.where("status IN ('pass', 'fail')").withColumn("field_id", F.explode("field_ids"))
    none = F.lit(None).cast("double")
    return _evidence(rows, "identity_rule", F.col("rule_id"), F.col("status") == "pass", none, none, F.lit(False), F.lit(None), F.lit(None))


def external(cells: DataFrame, mart: DataFrame, field_map: DataFrame, absolute: float = 1.0, share: float = 0.001) -> DataFrame:
    """An external mart (entity, year, category, value) against cells, through categories mapped to fields."""
    rows = mart.where("value IS NOT NULL").join(field_map, "category").withColumnRenamed("value", "vb")
    pairs = cells.where("value IS NOT NULL").withColumnRenamed("value", "va").join(rows, CELL)
    return _evidence(pairs, "factbook", F.col("category"), evidence_match(F.col("va"), F.col("vb"), absolute, share), F.col("va"), F.col("vb"), F.lit(False), F.lit(None), F.lit(None))


@dataclass(frozen=True)
class Policy:
    """When evidence confirms a cell without review."""

    min_independent: int = 2
    single_source_ok: tuple[str, ...] = ("MANUAL",)
    critical: tuple[str, ...] = ()
    # Methods of one source fall into one bucket; other methods count for none.
    buckets: dict[str, str] = field(default_factory=lambda: {"XBRL_CSV": "xbrl", "XBRL_SEGMENT": "xbrl", "XBRL_TEXT": "xbrl", "LOCAL_TABLE": "local_table", "MANUAL": "manual"})


SAME_YEAR = ("xbrl", "local_table", "manual", "external")


def resolve(cells: DataFrame, evidence: DataFrame, policy: Policy | None = None) -> DataFrame:
    """cells (CELL, value, method, validation_status) with counts, buckets, resolution and reason.

    One aggregation of the evidence to its cells (partial before the shuffle) and one left join.
    """
    policy = policy or Policy()
    bucket = F.create_map(*[F.lit(x) for kv in policy.buckets.items() for x in kv])
    own = cells.select(*CELL, F.col("value").alias("_cell"))
    rows = evidence.join(own, CELL)
    kind = F.col("check_kind")
    found = F.when(kind == "xbrl_vs_local", F.array(F.try_element_at(bucket, "method_a"), F.try_element_at(bucket, "method_b")))
    found = found.when((kind == "next_year_prior") & supports(F.col("primary_value"), F.col("_cell")), F.array(F.lit("cross_year")))
    found = found.when(kind == "identity_rule", F.array(F.lit("identity"))).when(kind == "factbook", F.array(F.lit("external")))
    conflict = ~F.col("matched") & ~F.col("restatement_suspected")
    counts = rows.groupBy(*CELL).agg(
        F.count_if("matched").alias("corroboration_count"),
        F.count_if(conflict).alias("conflict_count"),
        F.count_if(F.col("restatement_suspected")).alias("restatement_count"),
        F.count_if(conflict & kind.isin("xbrl_vs_local", "factbook")).alias("_value_conflicts"),
        F.count_if(conflict & (kind == "identity_rule")).alias("_identity_conflicts"),
        F.count_if(conflict & (kind == "next_year_prior")).alias("_year_conflicts"),
        F.min(F.when(conflict & (kind == "identity_rule"), F.col("check_ref"))).alias("_rule"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(F.when(F.col("matched"), found)))))).alias("buckets"),
    )
    out = cells.join(counts, CELL, "left")
    zero = ["corroboration_count", "conflict_count", "restatement_count", "_value_conflicts", "_identity_conflicts", "_year_conflicts"]
    out = out.fillna(0, zero).withColumn("buckets", F.coalesce("buckets", F.array().cast("array<string>"))).withColumn("_n", F.size("buckets"))
    need = F.when(F.col("field_id").isin(*policy.critical), max(2, policy.min_independent)).otherwise(policy.min_independent) if policy.critical else F.lit(policy.min_independent)
    plain = (
        F.when(F.col("validation_status") == "fail", F.struct(F.lit("needs_review").alias("r"), F.lit("validation_fail_blocks_auto_confirm").alias("w")))
        .when(F.col("_n") >= need, F.struct(F.lit("auto_confirmed").alias("r"), F.lit("").alias("w")))
        .when((F.col("_n") == 1) & F.col("method").isin(*policy.single_source_ok), F.struct(F.lit("auto_confirmed").alias("r"), F.lit("").alias("w")))
        .when(F.col("_n") == 1, F.struct(F.lit("single_source").alias("r"), F.lit("single_source_only").alias("w")))
        .otherwise(F.struct(F.lit("needs_review").alias("r"), F.lit("insufficient_corroboration").alias("w")))
    )
    same_year = F.size(F.array_intersect("buckets", F.array(*map(F.lit, SAME_YEAR)))) >= 2
    says = lambda r, w: F.struct(F.lit(r).alias("r"), (w if isinstance(w, Column) else F.lit(w)).alias("w"))
    verdict = (
        F.when(F.col("value").isNull(), says("no_value", ""))
        .when(F.col("conflict_count") == 0, plain)
        .when(F.col("_value_conflicts") > 0, says("conflicted", "value_disagreement"))
        .when((F.col("_identity_conflicts") > 0) & (F.col("_year_conflicts") == 0), says("needs_reconciliation", F.concat(F.lit("identity_group_mismatch:"), F.coalesce("_rule", F.lit("")))))
        .when((F.col("_year_conflicts") > 0) & same_year, F.when(plain["r"] == "auto_confirmed", says("auto_confirmed", "cross_year_divergence_likely_restatement")).otherwise(plain))
        .when(F.col("_year_conflicts") > 0, says("needs_review", "cross_year_mismatch"))
        .otherwise(says("needs_review", "unclassified_conflict"))
    )
    out = out.withColumn("_v", verdict).withColumn("resolution", F.col("_v.r")).withColumn("resolution_reason", F.col("_v.w"))
    return out.withColumn("independent_buckets", F.when(F.col("value").isNull(), 0).otherwise(F.col("_n"))).drop(*[z for z in zero if z[0] == "_"], "_rule", "_n", "_v")


def summarize(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts of matches, conflicts and suspected restatements for every cell, zero where there is no evidence."""
    counts = evidence.groupBy(*CELL).agg(
        F.count_if("matched").alias("corroboration_count"),
        F.count_if(~F.col("matched") & ~F.col("restatement_suspected")).alias("conflict_count"),
        F.count_if("restatement_suspected").alias("restatement_count"),
    )
    return cells.select(*CELL).distinct().join(counts, CELL, "left").fillna(0)

"""Coverage, golden values, consistency findings and mapping verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import golden_match
from .merge import last_wins


def coverage_matrix(entities: DataFrame, years: DataFrame, fields: list[str], filled: DataFrame, exclusions: DataFrame) -> DataFrame:
    """field_id x entity: expected, filled and blank counts, the blank years, and the rate. The grid is entities x years of the master, not of the data."""
    from .matching import without_excluded

    grid = entities.select("entity").distinct().join(years.select("entity", "year").distinct(), "entity")
    grid = grid.withColumn("field_id", F.explode(F.array(*map(F.lit, fields))))
    grid = without_excluded(grid, exclusions)
    has = filled.select("entity", "year", "field_id").distinct().withColumn("_f", F.lit(True))
    out = grid.join(has, ["entity", "year", "field_id"], "left").groupBy("field_id", "entity").agg(
        F.count("*").alias("expected"), F.count("_f").alias("filled"), F.array_sort(F.collect_list(F.when(F.col("_f").isNull(), F.col("year")))).alias("blank_years")
    )
    return out.withColumn("blank", F.col("expected") - F.col("filled")).withColumn("rate", F.round(F.col("filled") / F.col("expected"), 4))


def field_coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """filled, total and percent for each column, from one pass."""
    one = df.agg(F.count("*").alias("_rows"), *[F.count(f).alias(f) for f in fields])
    out = one.unpivot(["_rows"], fields, "field_id", "filled").withColumnRenamed("_rows", "total")
    return out.withColumn("pct", F.round(F.try_divide(F.col("filled") * 100, F.col("total")), 4))


GATED = ("manual", "auto_confirmed", "corroborated_2plus")


def freeze_golden(manual: DataFrame, confirmed: DataFrame, human: DataFrame, negative: DataFrame, keys: list[str]) -> DataFrame:
    """Golden values (keys, value, origin): human over confirmed over manual; negatives are taken out."""
    rows = manual.withColumn("_o", F.lit(0)).unionByName(confirmed.withColumn("_o", F.lit(1))).unionByName(human.withColumn("_o", F.lit(2)))
    return last_wins(rows, keys, "_o").drop("_o").join(negative.select(*keys).distinct(), keys, "left_anti")


def golden_diff(golden: DataFrame, negative: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of kinds value_mismatch, missing_in_actual, human_locked_unreproduced and negative_golden_violation."""
    got = actual.select(*keys, F.col("value").alias("actual"))
    joined = golden.select(*keys, F.col("value").alias("expected"), "origin").join(got, keys, "left")
    gated = F.col("origin").isin(*GATED)
    kind = F.when(F.col("actual").isNull(), F.when(gated, "missing_in_actual").otherwise("human_locked_unreproduced"))
    kind = kind.when(~F.coalesce(golden_match(F.col("expected"), F.col("actual")), F.lit(False)), F.when(gated, "value_mismatch").otherwise("human_locked_unreproduced"))
    wrong = joined.withColumn("kind", kind).where("kind IS NOT NULL")
    broken = got.where("actual IS NOT NULL").join(negative.select(*keys).distinct(), keys, "left_semi")
    broken = broken.select(*keys, F.lit(None).cast(golden.schema["value"].dataType).alias("expected"), F.lit("negative").alias("origin"), "actual", F.lit("negative_golden_violation").alias("kind"))
    return wrong.unionByName(broken)


def golden_summary(diff: DataFrame) -> DataFrame:
    """One row: counts by kind and whether the gated kinds have none."""
    kinds = ["value_mismatch", "missing_in_actual", "negative_golden_violation", "human_locked_unreproduced"]
    out = diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    return out.withColumn("passed", F.col(kinds[0]) + F.col(kinds[1]) + F.col(kinds[2]) == 0)


def duplicate_tags(fields: DataFrame) -> DataFrame:
    """Tags that several fields share: low where each field has scope markers and no two share one, else medium from two on."""
    rows = fields.select("field_id", F.array_distinct("markers").alias("markers"), F.explode(F.array_distinct("tags")).alias("tag"))
    out = rows.groupBy("tag").agg(F.array_sort(F.collect_set("field_id")).alias("field_ids"), F.flatten(F.collect_list("markers")).alias("m"), F.bool_and(F.size("markers") > 0).alias("marked"))
    apart = F.col("marked") & (F.size("m") == F.size(F.array_distinct("m"))) & (F.size("field_ids") == 2)
    return out.where(F.size("field_ids") >= 2).select("tag", "field_ids", F.when(apart, "low").otherwise("medium").alias("severity"))


def contradictory(mappings: DataFrame, item: str = "item", concept: str = "concept") -> DataFrame:
    """Items with confirmed mappings to more than one concept."""
    out = mappings.groupBy(item).agg(F.array_sort(F.collect_set(concept)).alias("concepts"))
    return out.where(F.size("concepts") > 1)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(canonical: DataFrame, defined: DataFrame, confirmed: DataFrame, key: str) -> DataFrame:
    return canonical.select(key).distinct().join(defined.select(key), key, "left_anti").join(confirmed.select(key), key, "left_anti")


def match_rate(pairs: DataFrame, keys: list[str], matched: Column, least: int = 3, share: float = 0.8, low: float = 0.1) -> DataFrame:
    """Overlap, matches, rate and verdict of a proposed mapping over the cells both sides have."""
    out = pairs.groupBy(*keys).agg(F.count("*").alias("overlap"), F.count_if(matched).alias("matches")).withColumn("rate", F.round(F.col("matches") / F.col("overlap"), 4))
    verdict = F.when(F.col("overlap") < least, "unverifiable").when(F.col("rate") >= share, "corroborated").when(F.col("rate") <= low, "conflicts").otherwise("weak")
    return out.withColumn("verdict", verdict)


def ambiguous_top(rows: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """Keys whose best-scored rows hold different values."""
    best = rows.groupBy(*keys).agg(F.max(score).alias("_top"))
    return rows.join(best, keys).where(F.col(score) == F.col("_top")).groupBy(*keys).agg(F.count_distinct(value).alias("values")).where("values > 1")

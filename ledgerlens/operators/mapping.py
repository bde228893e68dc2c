"""The mapping store: observed items, canonical concepts and the mappings between them, as three tables.

items: item, element, unit, ...; concepts: concept, name, status; mappings: mapping, item, concept, action, status,
decided_by, confidence. Every change gives a new table; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import stable_id


def unmapped(items: DataFrame, mappings: DataFrame, machine: str = "model:") -> DataFrame:
    """Items with no confirmed mapping and none that a machine has proposed."""
    taken = mappings.where((F.col("status") == "confirmed") | ((F.col("status") == "proposed") & F.startswith("decided_by", F.lit(machine)))).select("item")
    return items.join(taken, "item", "left_anti")


def hints(items: DataFrame, mappings: DataFrame) -> DataFrame:
    """(element, concept, uses): concepts that confirmed mappings gave to items of the same element, most used first."""
    used = mappings.where("status = 'confirmed'").select("item", "concept")
    return items.select("item", "element").join(used, "item").groupBy("element", "concept").agg(F.count("*").alias("uses"))


def chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Numbers the rows of each group in batches of `size`."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))


def decide(mappings: DataFrame, decisions: DataFrame, expected: str = "proposed") -> DataFrame:
    """mappings after decisions (mapping, new_status, new_decided_by); only those still in the expected status change."""
    out = mappings.join(decisions, "mapping", "left")
    go = F.col("new_status").isNotNull() & (F.col("status") == expected)
    return out.withColumn("decided_by", F.when(go, F.col("new_decided_by")).otherwise(F.col("decided_by"))).withColumn("status", F.when(go, F.col("new_status")).otherwise(F.col("status"))).select(*mappings.columns)


def promote(mappings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Confirms the machine's proposals that the numbers corroborate; a second run changes nothing."""
    won = verdicts.where("verdict = 'corroborated'").select("mapping", F.lit("confirmed").alias("new_status"), F.lit("numbers").alias("new_decided_by"))
    return decide(mappings, won.join(mappings.where("action = 'map'").select("mapping"), "mapping", "left_semi"))


def reject_conflicts(mappings: DataFrame, verdicts: DataFrame, reviewer: str) -> DataFrame:
    lost = verdicts.where("verdict = 'conflicts'").select("mapping", F.lit("rejected").alias("new_status"), F.lit(reviewer).alias("new_decided_by"))
    return decide(mappings, lost.join(mappings.where("action = 'map'").select("mapping"), "mapping", "left_semi"))


def new_concepts(proposals: DataFrame) -> DataFrame:
    """One concept for each proposed name, with the proposals it stands for: (concept, name, mappings, first_mapping)."""
    out = proposals.where("action = 'new_concept'").groupBy(F.trim("name").alias("name")).agg(F.array_sort(F.collect_set("mapping")).alias("mappings"))
    return out.withColumn("concept", stable_id("concept", F.col("name"))).withColumn("first_mapping", F.get("mappings", F.lit(0)))


def merge_concept(mappings: DataFrame, concepts: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """All mappings of source that are not rejected go to target; source is merged into it."""
    moved = (F.col("concept") == source) & (F.col("status") != "rejected")
    gone = F.col("concept") == source
    return (
        mappings.withColumn("concept", F.when(moved, F.lit(target)).otherwise(F.col("concept"))),
        concepts.withColumn("merged_into", F.when(gone, F.lit(target))).withColumn("status", F.when(gone, F.lit("merged")).otherwise(F.col("status"))),
    )


def concept_stats(concepts: DataFrame, mappings: DataFrame, cells: DataFrame) -> DataFrame:
    """Mappings by status and final values for each concept, zero where there are none."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    m = mappings.groupBy("concept").agg(F.count("*").alias("mappings"), of("confirmed"), of("proposed"))
    v = cells.where("value IS NOT NULL").groupBy(F.col("field_id").alias("concept")).agg(F.count("*").alias("final_values"))
    return concepts.select("concept").join(m, "concept", "left").join(v, "concept", "left").fillna(0)


def coverage(items: DataFrame, mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: items, items with a mapping, with a confirmed one, without any, and concepts without a mapping."""
    known = mappings.groupBy("item").agg(F.bool_or(F.col("status") == "confirmed").alias("sure"))
    a = items.select("item").distinct().join(known, "item", "left").agg(F.count("*").alias("items"), F.count("sure").alias("mapped"), F.count_if("sure").alias("confirmed"))
    b = concepts.select("concept").join(mappings.select("concept"), "concept", "left_anti").agg(F.count("*").alias("concepts_without_mapping"))
    return a.withColumn("unmapped", F.col("items") - F.col("mapped")).crossJoin(b)  # two tables of one row


def proposals(mappings: DataFrame, items: DataFrame, concepts: DataFrame, least: float = 0.0) -> DataFrame:
    """What a reviewer sees of the open proposals: the item, the concept and the confidence."""
    open_ = mappings.where((F.col("status") == "proposed") & (F.col("confidence") >= least))
    return open_.join(items, "item", "left").join(concepts.select("concept", F.col("name").alias("concept_name")), "concept", "left")


def enrichment(fields: DataFrame, mappings: DataFrame, items: DataFrame) -> DataFrame:
    """Tags that confirmed mappings add to a field's definition: (field_id, added, tags)."""
    seen = mappings.where("status = 'confirmed'").join(items.select("item", "element"), "item").groupBy(F.col("concept").alias("field_id")).agg(F.array_sort(F.collect_set("element")).alias("found"))
    out = fields.join(seen, "field_id").withColumn("added", F.array_except("found", "tags")).where(F.size("added") > 0)
    return out.select("field_id", "added", F.concat("tags", "added").alias("tags"))


def taxonomy_kind(element: Column) -> Column:
    """Kind of a taxonomy by the element's prefix."""
    prefix = F.lower(F.substring_index(element, ":", 1))
    return F.when(~element.contains(":"), "unknown").when(prefix.startswith("jppfs"), "primary").when(prefix.startswith("jpcrp"), "disclosure").when(prefix.startswith("ifrs") | prefix.startswith("jpigp"), "ifrs").otherwise("extension")

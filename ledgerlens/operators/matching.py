"""Matching of fields to facts by tags and contexts, documents to entities, and exclusions by year ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag_matches(local_name: Column, label: Column, token: Column) -> Column:
    """ASCII tokens equal the element's local name, letter case aside; others are part of the label."""
    return F.when(token.rlike("^[\\x00-\\x7F]+$"), F.lower(local_name) == F.lower(token)).otherwise(label.contains(token))


def tag_priority(tags: Column, local_name: Column, label: Column) -> Column:
    """Place of the first tag that matches; the number of tags if none does."""
    hits = F.transform(tags, lambda t: tag_matches(local_name, label, t))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(tags))


def context_matches(context: Column, tokens: list[str]) -> Column:
    """All tokens are part of the context; one that starts with ! must not be."""
    out = F.lit(True)
    for t in tokens:
        out = out & (~context.contains(t[1:]) if t[0] == "!" else context.contains(t))
    return out


def candidates(facts: DataFrame, fields: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """facts (keys, local_name, label, is_text, value, ord) for each field and its tags: tag match, non-text preferred, best priority, first of order; with the number of distinct values that are left.

    fields is a configuration. A fact finds its fields in one pass: names by a map from lower-case tags, labels by one test
    a tag; a fact then has one row for each field that it matches, and only these are grouped.
    """
    plain = lambda t: t.isascii()
    by_name: dict[str, list[tuple[str, int]]] = {}
    for f, tags in fields.items():
        for i, t in enumerate(tags):
            if plain(t):
                by_name.setdefault(t.lower(), []).append((f, i))
    hit = lambda f, i: F.struct(F.lit(f).alias("field_id"), F.lit(i).alias("priority"))
    none = F.array().cast("array<struct<field_id:string,priority:int>>")
    named = F.create_map(*[x for t, hits in by_name.items() for x in (F.lit(t), F.array(*[hit(f, i) for f, i in hits]))]) if by_name else None
    found = [F.coalesce(F.try_element_at(named, F.lower("local_name")), none)] if named is not None else []
    labels = [F.when(F.col("label").contains(t), hit(f, i)) for f, tags in fields.items() for i, t in enumerate(tags) if not plain(t)]
    if labels:
        found.append(F.array_compact(F.array(*labels)))
    rows = facts.withColumn("_h", F.explode(F.concat(*found) if found else none)).select(*facts.columns, "_h.field_id", "_h.priority")
    # Of several tags that match a fact the first counts: the least priority of the group is the least of all its facts.
    group = Window.partitionBy(*keys, "field_id")
    kept = rows.withColumn("_plain", F.min(F.col("is_text").cast("int")).over(group)).where(F.col("is_text").cast("int") == F.col("_plain"))
    best = kept.withColumn("_best", F.min("priority").over(group)).where(F.col("priority") == F.col("_best"))
    first = F.struct(*[c for c in rows.columns if c not in keys and c != "field_id"])
    out = best.groupBy(*keys, "field_id").agg(F.min_by(first, "ord").alias("_f"), F.count_distinct(F.trim("value")).alias("candidates"))
    return out.select(*keys, "field_id", "_f.*", "candidates")


def always(targets: DataFrame, fields: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every target and field; one that was not found says why. fields is a short configuration table."""
    grid = targets.select(*keys).distinct().crossJoin(F.broadcast(fields.select("field_id")))
    out = grid.join(found, [*keys, "field_id"], "left")
    return out.withColumn("reason", F.when(F.col("value").isNull(), "not_found")).withColumn("confidence", F.when(F.col("value").isNull(), 0.0).when(F.col("candidates") <= 1, 0.95).otherwise(0.75))


def effective(documents: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The document of each key that comes first in the order (corrections first, then the latest)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return documents.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def without_excluded(rows: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Rows (entity, field_id, year) no exclusion (entity, field_id, from_year, to_year; open ends null) covers.

    A row without a year is covered by an exclusion open at both ends only.
    """
    x = exclusions.select(F.col("entity").alias("_e"), F.col("field_id").alias("_f"), "from_year", "to_year")
    open_ = F.col("from_year").isNull() & F.col("to_year").isNull()
    inside = (F.col("from_year").isNull() | (F.col("year") >= F.col("from_year"))) & (F.col("to_year").isNull() | (F.col("year") <= F.col("to_year")))
    on = (F.col("entity") == F.col("_e")) & (F.col("field_id") == F.col("_f")) & (open_ | (F.col("year").isNotNull() & inside))
    return rows.join(x, on, "left_anti")

"""Marts and composite choices: segment sums with provenance, scoped lookups, target coverage, reconciliation groups, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import first_wins, last_wins


def segment_sum(facts: DataFrame, keys: list[str], priority: list[str], most_quotes: int = 6) -> DataFrame:
    """(keys, element, value, unit, quotes, parts): the sum over contexts of the first element in priority that a key has.

    facts: keys, element, context, broad, value, unit, quote, ord. Where a key has broad contexts only these count; of
    rows of one context the first counts.
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("element"))
    known = facts.where(F.col("element").isin(priority) & F.col("value").isNotNull()).withColumn("_r", rank)
    best = known.groupBy(*keys).agg(F.min(F.struct("_r", (~F.col("broad")).alias("narrow"))).alias("_b"))
    kept = known.join(best, keys).where((F.col("_r") == F.col("_b._r")) & (F.col("broad") != F.col("_b.narrow"))).drop("_b", "_r")
    one = first_wins(kept, [*keys, "context"], "ord")
    quotes = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "quote"))), 1, most_quotes), lambda x: x["quote"])
    return one.groupBy(*keys).agg(F.min("element").alias("element"), F.sum("value").alias("value"), F.min_by("unit", "ord").alias("unit"), F.array_join(quotes, " / ").alias("quotes"), F.count("*").alias("parts"))


def scoped_lookup(rows: DataFrame, table: DataFrame, levels: list[list[str]], target: str, default: str | None = None) -> DataFrame:
    """rows with `target` from the first level of keys, from the most special on, under which the lookup table has an entry.

    table: level, key, target; a key is its columns joined by |. One join a level, of few entries each.
    """
    out, found = rows, []
    for i, keys in enumerate(levels):
        own = table.where(F.col("level") == i).select(F.col("key").alias(f"_k{i}"), F.col(target).alias(f"_t{i}"))
        out = out.join(own, F.concat_ws("|", *keys) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_t{i}"))
    return out.withColumn(target, F.coalesce(*found, F.lit(default))).drop(*[f"_t{i}" for i in range(len(levels))])


def target_coverage(entities: DataFrame, metrics: list[str], documents: DataFrame, parsed: DataFrame) -> DataFrame:
    """entity x metric: documents, parsed rows, latest parsed year and a status: covered, document_only or missing."""
    grid = entities.select("entity").distinct().withColumn("metric", F.explode(F.array(*map(F.lit, metrics))))
    d = documents.groupBy("entity").agg(F.count("*").alias("documents"))
    p = parsed.groupBy("entity", "metric").agg(F.count("*").alias("parsed"), F.max("year").alias("latest_year"))
    out = grid.join(d, "entity", "left").join(p, ["entity", "metric"], "left").fillna(0, ["documents", "parsed"])
    return out.withColumn("status", F.when(F.col("parsed") > 0, "covered").when(F.col("documents") > 0, "document_only").otherwise("missing"))


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """new over old by key, where the column `kept` (as a time of creation) stays as it first was."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    first = both.groupBy(*keys).agg(F.min_by(kept, F.when(F.col(kept).isNotNull(), F.col("_side"))).alias("_first"))
    out = last_wins(both, keys, "_side").join(first, keys).withColumn(kept, F.coalesce("_first", kept))
    return out.select(*old.columns)


def reconciliation_groups(queue: DataFrame, prefix: str = "identity_group_mismatch:", samples: int = 8) -> DataFrame:
    """(group_id, items, cells_years, fields, samples): queue rows gathered by the identity that failed for them."""
    reason = F.explode(F.filter(F.split("review_reason", ";"), lambda r: r.startswith(prefix)))
    rows = queue.withColumn("group_id", reason).withColumn("group_id", F.substr("group_id", F.lit(len(prefix) + 1)))
    keys = F.struct("entity", "year", "field_id")
    return rows.groupBy("group_id").agg(F.count("*").alias("items"), F.count_distinct("entity", "year").alias("entity_years"), F.count_distinct("field_id").alias("fields"), F.slice(F.array_sort(F.collect_set(keys)), 1, samples).alias("samples"))


def audit_projection(rows: DataFrame, fields: DataFrame, columns: list[str]) -> DataFrame:
    """The audit columns of rows, absent ones as nulls, with the field's name or else its id."""
    named = rows.join(fields.select("field_id", F.col("field_name").alias("_name")), "field_id", "left").withColumn("field_name", F.coalesce("_name", "field_id"))
    return named.select(*[F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in columns])


def split_rows(rows: DataFrame, accepted: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are accepted and those for manual work; an unknown answer is manual."""
    ok = F.coalesce(accepted, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def low_coverage(fields: DataFrame, cells: DataFrame, least: int = 5) -> DataFrame:
    """Fields with fewer values than `least`; none at all is for information."""
    n = cells.where("value IS NOT NULL").groupBy("field_id").agg(F.count("*").alias("values"))
    out = fields.select("field_id").join(n, "field_id", "left").fillna(0, ["values"]).where(F.col("values") < least)
    return out.withColumn("severity", F.when(F.col("values") == 0, "info").otherwise("low"))


def reproduction_rate(fits: DataFrame, keys: list[str], confidence: str, least: float = 0.9) -> DataFrame:
    """Share of a layout's cells that are found again with confidence."""
    return fits.groupBy(*keys).agg(F.count("*").alias("cells"), F.round(F.avg(F.when(F.col(confidence) >= least, 1.0).otherwise(0.0)), 4).alias("rate"))


def digest(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of facts by kind and scope for each document."""
    of = lambda c, v: F.count_if(F.col(c) == v)
    return facts.groupBy(*keys).agg(F.count("*").alias("facts"), of("value_type", "numeric").alias("numeric"), of("value_type", "text").alias("texts"), of("normalized_scope", "standalone").alias("standalone"))


def latest(df: DataFrame, period: str) -> DataFrame:
    """One row: the latest period by its number, then by its text."""
    key = F.struct(F.regexp_extract(period, "([0-9]+)", 1).try_cast("long").alias("n"), F.col(period).alias("t"))
    return df.agg(F.max(key).alias("k")).select(F.col("k.t").alias(period))

"""Keyed merges, deletes, first and last choice, set operations. Order comes from explicit ordinals, never from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _choose(df: DataFrame, keys: list[str], order: Column, pick) -> DataFrame:
    """One row a key by an aggregate over (order, row): partial before the shuffle, so a hot key costs no sort."""
    row = F.struct(order.alias("o"), F.struct(*df.columns).alias("row"))
    return df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(pick(row).alias("best")).select("best.row.*")


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return _choose(df, keys, F.col(ordinal), F.max)


def first_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    return _choose(df, keys, F.col(ordinal), F.min)


def merge(old: DataFrame, new: DataFrame, keys: list[str], protected: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal keys; rows of old that are protected stay.

    A row of null keys only is keyed by its whole content.
    """
    columns = old.columns
    guard = F.coalesce(protected, F.lit(False)) if protected is not None else F.lit(False)
    a = old.withColumn("_side", F.when(guard, 2).otherwise(0))
    b = new.withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    none = F.lit(True)
    for k in keys:
        none = none & F.col(k).isNull()
    both = both.withColumn("_whole", F.when(none, F.to_json(F.struct(*columns))))
    return _choose(both, [*keys, "_whole"], F.col("_side"), F.max).select(*columns)


def delete(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def scoped_replace(old: DataFrame, new: DataFrame, scope: DataFrame, scope_keys: list[str], keys: list[str]) -> DataFrame:
    """Rows of old in the refreshed scope go, then new is merged in."""
    return merge(delete(old, scope, scope_keys), new, keys)


def full_compare(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Full outer comparison of two tables of unique keys, with a status for each key."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    x, y = F.col("old_value"), F.col("new_value")
    status = F.when(F.col("_a").isNull(), "new_only").when(F.col("_b").isNull(), "old_only").when(x.isNull() & y.isNull(), "both_blank")
    status = status.when(F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)), "match").otherwise("mismatch")
    return a.join(b, keys, "full_outer").withColumn("status", status).drop("_a", "_b")


def suppress_blanks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Blank candidates go where their key has any value; null is a key like any other."""
    valued = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn("_has", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(valued, same, "left").where(F.col(value).isNotNull() | F.col("_has").isNull()).select(*df.columns)


def prefer_if_any(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows that meet the condition where a key has any; all of its rows where it has none."""
    marked = df.withColumn("_ok", F.coalesce(condition, F.lit(False)))
    has = marked.groupBy(*keys).agg(F.bool_or("_ok").alias("_any"))
    return marked.join(has, keys).where("_ok OR NOT _any").drop("_ok", "_any")


def lowest_rank(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The rows at the smallest rank of their key, all of them."""
    least = df.groupBy(*keys).agg(F.min(rank).alias("_least"))
    return df.join(least, keys).where(F.col(rank) == F.col("_least")).drop("_least")

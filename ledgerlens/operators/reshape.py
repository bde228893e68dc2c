"""Choice of one row a cell, long to wide and back, ratios, leads and chart matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import safe_ratio

# Ranks of review states and of sources.
STATUS_RANK = {"corrected": 4, "approved": 3, "auto_accepted": 2, "unreviewed": 1}


def unpivot(df: DataFrame, keys: list[str], fields: list[str], name: str = "field_id", value: str = "value") -> DataFrame:
    return df.unpivot(keys, fields, name, value)


def best_row(rows: DataFrame, keys: list[str], score: list[Column], ordinal: str) -> DataFrame:
    """The row of each key with the largest score; of equals the later one. One aggregation, no sort of a key's rows."""
    packed = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)], F.col(ordinal).alias("o"), F.struct(*rows.columns).alias("row"))
    return rows.groupBy(*keys).agg(F.max(packed).alias("best")).select("best.row.*")


def priority_pivot(rows: DataFrame, fields: list[str], preferred: str, ordinal: str = "ordinal") -> DataFrame:
    """Long rows (entity, year, field_id, value, status, method) to wide: corrected over approved over automatic, then the preferred method, then the later row."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), "status"), F.lit(0))
    score = F.struct(rank.alias("a"), (F.col("method") == preferred).alias("b"), F.col(ordinal).alias("c"))
    return rows.groupBy("entity", "year").pivot("field_id", fields).agg(F.max_by("value", score))


def with_ratios(df: DataFrame, ratios: dict[str, tuple[str, list[str]]], digits: int = 4) -> DataFrame:
    """name: (numerator, denominators); a denominator column that is null makes the ratio null, as does a zero sum."""
    for name, (top, bottom) in ratios.items():
        total = F.col(bottom[0])
        for b in bottom[1:]:
            total = total + F.col(b)
        df = df.withColumn(name, F.round(safe_ratio(F.col(top), total), digits))
    return df


def with_lead(df: DataFrame, value: str, keys: list[str], order: str, digits: int = 4) -> DataFrame:
    """The next row's value and the growth to it; null at the end and from zero."""
    ahead = F.lead(value).over(Window.partitionBy(*keys).orderBy(order))
    out = df.withColumn(f"next_{value}", ahead)
    return out.withColumn(f"{value}_growth", F.round(safe_ratio(F.col(f"next_{value}") - F.col(value), F.col(value)), digits))


def period_pivot(df: DataFrame, entity: str, period: str, periods: list, value: str) -> DataFrame:
    return df.groupBy(entity).pivot(period, periods).agg(F.first(value))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.dropna(subset=[x, y])


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r of pairs that are both there; null for fewer than two or without variance."""
    pairs = df.dropna(subset=[x, y])
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return pairs.groupBy(*keys).agg(F.count("*").alias("points"), F.when(F.count("*") >= 2, r).alias("r"))

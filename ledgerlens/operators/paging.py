"""What a client reads: pages, facets, searches and chart slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    """One page: size within 1 and 500, number from 1. A sort with offset and limit, so no task sorts the whole table."""
    size, number = min(max(size, 1), 500), max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, size: int = 50, least_pages: int = 1) -> DataFrame:
    size = min(max(size, 1), 500)
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.ceil(F.col("total") / size), F.lit(least_pages)).cast("long"))


def search(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of which any column contains the query, letter case aside."""
    everything = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns or df.columns]))
    return df.where(everything.contains(query.lower()))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Counts by value; null and blank are one bucket."""
    key = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("(blank)"))
    return df.groupBy(key.alias(column)).agg(F.count("*").alias("rows"))


def top_groups(df: DataFrame, columns: list[str], limit: int = 12) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), *columns).limit(limit)


def chart_slice(df: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first rows of a chart in order; the caller reports the rest from page_info()."""
    return df.orderBy(*order).limit(most)

"""Composite reads: wide pages with derived values, options, the review queue with facets, one cell's detail, status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import facet, page
from .reshape import with_ratios

CELL = ["entity", "year", "field_id"]


def wide_page(wide: DataFrame, entities: list[str] | None, years: list[int] | None, fields: list[str], ratios: dict, number: int = 1, size: int = 50) -> DataFrame:
    """Filters reach the scan; only the page's columns are read; ratios are derived on the page."""
    rows = wide
    if entities:
        rows = rows.where(F.col("entity").isin(entities))
    if years:
        rows = rows.where(F.col("year").isin(years))
    need = {c for top, bottom in ratios.values() for c in (top, *bottom)} - set(fields)
    one = page(rows.select("entity", "year", *fields, *sorted(need)), ["entity", "year"], number, size)
    return with_ratios(one, ratios).select("entity", "year", *fields, *ratios)


def options(wide: DataFrame, columns: list[str]) -> DataFrame:
    """(kind, value, rows): the values a client may choose from."""
    out = None
    for c in columns:
        one = facet(wide, c).select(F.lit(c).alias("kind"), F.col(c).alias("value"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def queue_with_saved(queue: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """The queue with what is saved laid over it: saved values first."""
    s = saved.select(*keys, F.col("decision").alias("saved_decision"), F.col("corrected_value").alias("saved_value"))
    out = queue.join(s, keys, "left")
    return out.withColumn("review_saved", F.col("saved_decision").isNotNull()).withColumn("shown_value", F.coalesce("saved_value", "value"))


def queue_page(queue: DataFrame, category: str | None, order: list, number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page, and the counts of all categories before the category filter."""
    rows = queue.where(F.col("category") == category) if category else queue
    return page(rows, order, number, size), facet(queue, "category")


def cell_detail(final: DataFrame, audit: DataFrame, evidence: DataFrame, decisions: DataFrame, entity: str, year: int, field: str, most: int = 20) -> DataFrame:
    """One row with all that is known of a cell; filters on the key reach every scan, lists are bounded."""
    at = (F.col("entity") == entity) & (F.col("year") == year) & (F.col("field_id") == field)
    listed = lambda df, name: df.where(at).agg(F.slice(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in CELL]))), 1, most).alias(name))
    key = final.sparkSession.createDataFrame([(entity, year, field)], "entity string, year int, field_id string")
    out = key.join(final.where(at), CELL, "left")
    for df, name in ((audit, "audit"), (evidence, "evidence"), (decisions, "decisions")):
        out = out.crossJoin(listed(df, name))  # each side is one row
    return out


def similar_counts(queue: DataFrame, entity: str, field: str) -> DataFrame:
    """How many open rows share the cell's field, its entity, or both."""
    e, f = F.col("entity") == entity, F.col("field_id") == field
    return queue.agg(F.count_if(e & f).alias("same_cell_series"), F.count_if(e).alias("same_entity"), F.count_if(f).alias("same_field"))


def inventory(rows: DataFrame, methods: list[str]) -> DataFrame:
    """Rows of each field by method."""
    return rows.groupBy("field_id").pivot("method", methods).agg(F.count(F.lit(1))).fillna(0)


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of each table, for a status view."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def findings(final: DataFrame, audited: DataFrame, wide_cells: DataFrame) -> DataFrame:
    """Consistency of the published tables: keys without audit, audits without a key, duplicate keys, long and wide that differ.

    Values are the same within 1e-9 of the larger one, but never more than half a unit apart: beyond 5e8 the share alone would pass whole units.
    """
    key = lambda df: df.select(*CELL)
    named = lambda df, kind, severity: df.groupBy().agg(F.count("*").alias("rows")).select(F.lit(kind).alias("finding"), F.lit(severity).alias("severity"), "rows")
    values = final.where("value IS NOT NULL")
    both = values.select(*CELL, F.col("value").alias("a")).join(wide_cells.where("value IS NOT NULL").select(*CELL, F.col("value").alias("b")), CELL, "full_outer")
    differ = both.where("a IS NULL OR b IS NULL OR NOT (a = b OR abs(a - b) <= least(greatest(abs(a), abs(b)) * 1e-9, 0.5))")  # infinities are equal, their difference is not a number
    parts = [
        (key(values).join(key(audited), CELL, "left_anti"), "final_without_audit", "high"),
        (key(audited).join(key(final), CELL, "left_anti"), "audit_without_final", "medium"),
        (final.groupBy(*CELL).count().where("count > 1"), "duplicate_keys", "high"),
        (differ, "wide_differs_from_long", "high"),
    ]
    out = None
    for p in parts:
        one = named(*p)
        out = one if out is None else out.unionByName(one)
    return out

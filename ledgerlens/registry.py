"""The registered queries of the library, and SQL that gives the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import actions, blocks, cells, chain, governance, marts, parsing, series, store  # noqa: F401  they register their queries
from .plans.base import REGISTRY, SQL

QUERIES = REGISTRY
ORACLE_SQL = SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide entity and year table with ratios and growth: scan, joins, aggregation, window and projection."""
    return cells.analysis_wide(spark, sf_dir)

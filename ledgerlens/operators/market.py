"""Price series and marts: bars, returns over gaps, group sums against totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import safe_ratio


def bars(ticks: DataFrame, keys: list[str], ts: str, value: str, order: str) -> DataFrame:
    """open, high, low, close of each key: one aggregation, partial before the shuffle."""
    at = F.struct(F.col(ts), F.col(order))
    return ticks.groupBy(*keys).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.count("*").alias("ticks")
    )


def returns(series: DataFrame, keys: list[str], order: str, close: str, digits: int = 8) -> DataFrame:
    """Return against the last close that is there, across gaps; none from a zero or missing base."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = series.withColumn("previous_close", F.last(close, ignorenulls=True).over(w))
    return out.withColumn("monthly_return", F.round(safe_ratio(F.col(close) - F.col("previous_close"), F.col("previous_close")), digits))


def product_of_factors(df: DataFrame, keys: list[str], factor: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.product(factor).alias("factor"), F.count(factor).alias("splits"))


def compare_mart(mart: DataFrame, wide: DataFrame, keys: list[str], value: str, reference: str, absolute: float = 100.0, share: float = 0.005) -> DataFrame:
    """Mart rows against the reference: within the absolute or the relative tolerance passes; zero tolerances are legal."""
    out = mart.join(wide.select(*keys, F.col(reference).alias("reference")), keys, "left").withColumn("difference", F.col(value) - F.col("reference"))
    near = (F.abs("difference") <= absolute) | (F.abs("difference") <= F.abs("reference") * share)
    status = F.when(F.col("reference").isNull(), "no_reference").when(F.col(value).isNull(), "no_value").when(near, "pass").otherwise("mismatch")
    return out.withColumn("status", status)


def group_sums(rows: DataFrame, keys: list[str], value: str, totals: DataFrame, total: str, absolute: float = 100.0, share: float = 0.005) -> DataFrame:
    """Sum of each group against a total, only where no part is null."""
    sums = rows.groupBy(*keys).agg(F.sum(value).alias("group_total"), F.count_if(F.col(value).isNull()).alias("nulls")).where("nulls = 0").drop("nulls")
    return compare_mart(sums, totals, keys, "group_total", total, absolute, share)


def overall(statuses: DataFrame) -> DataFrame:
    """One row: counts and the overall status, a mismatch before incompleteness."""
    c = statuses.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "mismatch").alias("mismatched"))
    c = c.withColumn("pending", F.col("rows") - F.col("passed") - F.col("mismatched"))
    return c.withColumn("overall", F.when(F.col("mismatched") > 0, "mismatch").when(F.col("pending") > 0, "incomplete").otherwise("completed"))

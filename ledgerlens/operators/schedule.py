"""Calendars and due tests for refreshes, and the roll-forward of the year master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def target_month_end(today: Column, include_current: bool = False) -> Column:
    return F.last_day(today if include_current else F.add_months(today, -1))


def refresh_due(today: Column, last_month: Column, run_day: int = 5) -> Column:
    """Whether the target month is later than the last one done, from the run day of the month on."""
    target = F.date_format(target_month_end(today), "yyyy-MM")
    return (F.coalesce(last_month, F.lit("")) < target) & (F.dayofmonth(today) >= run_day)


def filing_windows(windows: DataFrame, today: Column, passed: list[str] = ()) -> DataFrame:
    """windows (name, start_month, start_day, end_month, end_day) over four filing years around today: dates, target year, whether open. An end before its start is in the next year."""
    years = F.explode(F.sequence(F.year(today) - 1, F.year(today) + 2))
    out = windows.withColumn("filing_year", years).withColumn("window_start", F.make_date("filing_year", "start_month", "start_day"))
    end = F.make_date("filing_year", "end_month", "end_day")
    out = out.withColumn("window_end", F.when(end < F.col("window_start"), F.add_months(end, 12)).otherwise(end))
    return out.select(*passed, "name", (F.col("filing_year") - 1).alias("target_year"), "window_start", "window_end", today.between(F.col("window_start"), F.col("window_end")).alias("in_window"))


def next_window(windows: DataFrame, today: Column) -> DataFrame:
    return windows.where(F.col("window_start") > today).orderBy("window_start", "name").limit(1)


def day_range(start: Column, end: Column) -> Column:
    return F.sequence(start, end)


def fetch_range(securities: DataFrame, stored: DataFrame, start: Column, end: Column) -> DataFrame:
    """(security, from_date, to_date) to fetch: from the last stored bar on, within the time of listing; ranges that are empty go."""
    last = stored.groupBy("security").agg(F.max("date").alias("_last"))
    out = securities.join(last, "security", "left").withColumn("from_date", F.greatest(F.coalesce("_last", start), F.col("listed_from"))).withColumn("to_date", F.least(end, F.col("listed_to")))
    return out.where(F.col("from_date") <= F.col("to_date")).select("security", "from_date", "to_date")


def split_errors(errors: DataFrame, securities: DataFrame, at: Column) -> DataFrame:
    """Errors marked by whether the security was listed at that time."""
    listed = (F.coalesce("listed_from", F.lit("1900-01-01").cast("date")) <= at) & (F.coalesce("listed_to", F.lit("9999-12-31").cast("date")) >= at)
    return errors.join(securities, "security", "left").withColumn("active", F.coalesce(listed, F.lit(True))).select(*errors.columns, "active")


def roll_forward(master: DataFrame, year: int, reset: list[str]) -> DataFrame:
    """Rows for a new year: each entity's latest row with the fields in reset emptied; those that exist already are left out."""
    latest = master.withColumn("_r", F.row_number().over(Window.partitionBy("entity").orderBy(F.col("year").desc()))).where("_r = 1").drop("_r")
    fresh = latest.withColumn("year", F.lit(year).cast(master.schema["year"].dataType))
    for c in reset:
        fresh = fresh.withColumn(c, F.lit(None).cast(master.schema[c].dataType))
    return fresh.join(master.select("entity", "year"), ["entity", "year"], "left_anti")


def staleness(last: Column, now: Column, most_days: int) -> Column:
    """Whether an output is missing or older than so many days."""
    return last.isNull() | (F.date_diff(now, last) > most_days)

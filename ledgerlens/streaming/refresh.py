"""Incremental refresh: new files arrive as a stream and are merged into a versioned table by key; late data in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import last_wins, merge
from ..sources import sinks


def merge_batches(spark: SparkSession, source: DataFrame, base: str, checkpoint: str, keys: list[str], ordinal: str):
    """Merges all that is available and ends: within a batch the last row of a key wins, then the batch wins over the table.

    A batch that is run again after a failure merges the same rows again, with the same result.
    """

    def upsert(batch: DataFrame, _number: int) -> None:
        new = last_wins(batch, keys, ordinal)
        try:
            old = sinks.current(batch.sparkSession, base)
        except FileNotFoundError:
            old = new.limit(0)
        sinks.replace(merge(old, new, keys), base)

    return source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(upsert).start()


def gated(steps: list[tuple[str, object]], gate) -> list[dict]:
    """Runs named steps in order and returns a summary of each. A step is a function without arguments, or None for the gate:
    gate() -> (ready, reasons) is asked there, and if it is not ready the steps behind it are skipped. A step that fails ends the run with its error in the summary.
    """
    out: list[dict] = []
    closed = False
    for name, step in steps:
        if closed:
            out.append({"step": name, "status": "skipped"})
        elif step is None:
            ready, reasons = gate()
            closed = not ready
            out.append({"step": name, "status": "ready" if ready else "blocked", "reasons": list(reasons)})
        else:
            try:
                out.append({"step": name, "status": "done", "result": step()})
            except Exception as e:  # noqa: BLE001  the summary says what failed
                out.append({"step": name, "status": "failed", "error": str(e)})
                closed = True
    return out


def poll_if_due(due: bool, refresh, force: bool = False) -> dict:
    """Refreshes when it is due or forced, else says that it was skipped; for a scheduler's job."""
    if not (due or force):
        return {"status": "skipped"}
    return {"status": "done", "result": refresh()}


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are not added."""
    marked = events.withWatermark(ts, late)
    out = marked.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "rows", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows: runs of events of a key with no longer gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("rows"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "rows")

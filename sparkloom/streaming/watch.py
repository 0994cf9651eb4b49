"""Structured Streaming: debounced change events, windowed counts and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def debounced(events: DataFrame, key: str, ts: str, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Last action of each session of changes of one key; sessions close after ``gap`` without a change."""
    session = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(ts, gap))
    return session.agg(F.max_by("action", ts).alias("action"), F.max(ts).alias("released"), F.count("*").alias("events")).drop("session_window")


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling or sliding windows; rows later than the watermark are left out."""
    span = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(span, F.col(kind)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def route(action: str, path: str) -> str:
    """What to do about a change of ``path``."""
    if path.endswith((".toml", ".config")):
        return "reload_config"
    document = path.endswith((".md", ".txt"))
    if action == "delete":
        return "remove_document" if document else "remove_code"
    return "reindex_document" if document else "reindex_code"


def refresh(changes: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``handle`` on each micro-batch of ``changes``; with ``once`` it ends when all that is there is done."""
    writer = changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()

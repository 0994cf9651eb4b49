"""Streams with state of their own: debounced changes with cancelling, and joins of two streams whose state the watermark clears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced_changes(events: DataFrame, path: str, ts: str, action: str, gap: int, late: str = "10 seconds") -> DataFrame:
    """(path, action, changed) of a stream of ``events``: changes that stood for ``gap`` milliseconds, and deletions. Needs RocksDB as the state store.

    Deletions go out at once. A later change within the gap restarts a change's time, a deletion drops what is pending: both lengthen a session of the path, whose last change goes out
    when the watermark passes its end, if it is no deletion. Changes that come out of order within the watermark's delay count as if in order; those behind the
    watermark are left out. Changes of one path at the same millisecond are one, a deletion among them wins.
    The state is what happened within the delay and the gap: equal changes are dropped in one operator, a path's session is one row of another, neither calls Python.
    """
    at = F.timestamp_millis(F.unix_millis(ts))
    rows = events.select(F.col(path).cast("string").alias("path"), F.col(action).eqNullSafe("delete").alias("gone"), F.col(action).alias("action"), at.alias("changed")).withWatermark("changed", late)
    once = rows.dropDuplicates(["path", "changed", "gone"])
    # Half a millisecond less than the gap: changes that are a whole gap apart are two, whether Spark joins sessions that only touch or not.
    session = F.session_window("changed", f"{gap * 1000 - 500} microseconds")
    last = once.groupBy("path", session).agg(F.max(F.struct("changed", "gone", "action")).alias("last"))
    stood = last.where("not last.gone").select("path", "last.action", "last.changed")
    return stood.unionByName(once.where("gone").select("path", "action", F.expr("timestamp_micros(unix_micros(changed))").alias("changed")))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows of two streams with equal ``key`` where the right one comes up to ``within`` after the left one.

    Both sides have a watermark, and the bounds on both times let Spark drop a row from the state once no partner can come: the state holds what
    happened within ``within`` and ``late``, however long the stream runs. Column names of the sides must differ but for the key.
    """
    a = left.withWatermark(left_ts, late)
    b = right.withWatermark(right_ts, late).withColumnRenamed(key, f"_{key}")
    near = (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col(f"_{key}")) & near).drop(f"_{key}")

"""Windowed aggregates of an event stream. An extension: the same expressions run on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", group: str = "event_type", value: str = "value") -> DataFrame:
    """Count, sum and maximum by window and group. On a stream, rows later than ``late`` are left out."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("most")).select(F.col("w.start").alias("start"), group, "n", "total", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", ts: str = "ts", group: str = "user_id") -> DataFrame:
    """Sessions of each group, ended by a gap."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet from what is available now, with exactly-once files."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

"""Debounced change events: a path is handled when it has been quiet for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str | None = "10 seconds") -> DataFrame:
    """(path, started, ended, n): one row for each burst of events (path, ts); works on batches and, with a watermark, on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming and late else events
    s = F.session_window("ts", quiet)
    return rows.groupBy("path", s.alias("s")).agg(F.count("*").alias("n")).select("path", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")

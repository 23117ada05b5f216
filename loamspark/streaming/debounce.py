"""Debounced and de-duplicated event streams; each function also takes a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, value: str, gap: str = "60 seconds", late: str | None = "10 minutes") -> DataFrame:
    """key, started_at, fires_at, n, first_value, last_value: a burst fires once after a quiet gap, with its first and last value. late: None if events have a watermark."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    burst = rows.groupBy(key, F.session_window(ts, gap).alias("burst"))
    out = burst.agg(F.count("*").alias("n"), F.min_by(value, ts).alias("first_value"), F.max_by(value, ts).alias("last_value"))
    return out.select(key, F.col("burst.start").alias("started_at"), F.col("burst.end").alias("fires_at"), "n", "first_value", "last_value")


def once(events: DataFrame, event_id: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """Each event id once; a replayed id is ignored within the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event_id])
    return events.dropDuplicates([event_id])

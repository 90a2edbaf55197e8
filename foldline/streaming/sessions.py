"""Sessions over a stream: the batch operator's gap rule with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_counts(events: DataFrame, *, ts: str = "ts", keys: list[str], gap: str = "12 hours", lateness: str = "1 day") -> DataFrame:
    """Rows, first and last time of each key's sessions; a session closes when the watermark passes its gap.

    Works on static and streaming frames alike; rows later than ``lateness`` are left out of a stream's sessions.
    """
    rows = events.withWatermark(ts, lateness) if events.isStreaming else events
    return rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).drop("w")

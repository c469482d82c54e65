"""Graph statistics over a stream of interactions (extension: the batch operators have no streaming form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(events: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts", src: str = "user_id", dst: str = "event_type") -> DataFrame:
    """(start, dst, degree, weight): edges src -> dst by tumbling window; works on batch and streaming input, where rows later than late are dropped by the watermark."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, window).alias("w"), F.col(dst).alias("dst")).agg(F.count(src).alias("degree"), F.sum("value").alias("weight")).select(F.col("w.start").alias("start"), "dst", "degree", "weight")

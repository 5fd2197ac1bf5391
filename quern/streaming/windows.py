"""Extension: calendar windows of events as a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark (which needs a zoned time); a static frame as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed(events: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """n and total by window and type; on a static frame the same without the watermark."""
    rows = watermarked(events, ts, late)
    out = rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", by: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = watermarked(events, ts, late)
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")

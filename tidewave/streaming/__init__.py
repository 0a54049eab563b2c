"""The windowed statistics over a stream: an extension, on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import crest_db


def windowed_levels(events: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Peak, RMS and crest factor per key and event-time window; works on batches and on streams."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    x = F.col("value")
    s = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"), F.count("*").alias("n"))
    return s.select(F.col("window.start").alias("window_start"), "event_type", "n", "peak", "rms", crest_db(F.col("peak"), F.col("rms")).alias("crest_factor_db"))

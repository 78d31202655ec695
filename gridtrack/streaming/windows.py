"""Accumulation to the tracking step on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accumulate_stream(events: DataFrame, dt_hours: int, lateness: str = "1 hour", ts: str = "ts", value: str = "v", cells: tuple[str, ...] = ("iy", "ix")) -> DataFrame:
    """start, cells, total, peak, n of each window of dt_hours; a window is given out once the watermark has passed its end, so the last unfinished one never is."""
    w = F.window(ts, f"{dt_hours} hours")
    out = events.withWatermark(ts, lateness).groupBy(w.alias("w"), *cells).agg(F.sum(value).alias("total"), F.max(value).alias("peak"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *cells, "total", "peak", "n")

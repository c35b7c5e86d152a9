"""Event-time windows over series, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """Events under a watermark, whose time column must have a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and mean per window and keys. On a stream, `late` is the watermark."""
    rows = _marked(events, time, late)
    out = rows.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("begins"), *keys, "n", "mean")


def sliding(events: DataFrame, time: str, width: str, slide: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = _marked(events, time, late)
    out = rows.groupBy(F.window(time, width, slide), *keys).agg(F.count("*").alias("n"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("begins"), *keys, "n", "most")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    rows = _marked(events, time, late)
    out = rows.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), *keys, "n", "total")

"""Streams: counts and sums of late-arriving rows in windows, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(rows: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Works on streams and on tables alike: n and total for each window and key."""
    return rows.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")

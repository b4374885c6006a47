"""Counts of entry streams (an extension: the declared tool has no stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(entries: DataFrame, keys: list[str], length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and bytes by keys and window of start, from a stream or a table of entries; rows later than ``late`` are left out of a stream."""
    timed = entries.where("started is not null").withWatermark("started", late)
    return timed.groupBy(*keys, F.window("started", length).alias("w")).agg(F.count("*").alias("requests"), F.sum("content_bytes").alias("bytes")).select(*keys, F.col("w.start").alias("started"), "requests", "bytes")

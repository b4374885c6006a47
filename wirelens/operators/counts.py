"""Count facts: requests and payload sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEASURES = ("request_body_bytes", "response_body_bytes", "content_bytes")


def request_counts(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Requests by ``keys``: requests, and those without a duration (unmeasured)."""
    return entries.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(F.col("duration").isNull()).alias("unmeasured"))


def payload_bytes(entries: DataFrame, keys: list[str], measure: str = "response_body_bytes") -> DataFrame:
    """Bytes by ``keys``: sum, largest, and the number of entries whose size is known; a sum over no known size is null."""
    if measure not in MEASURES:
        raise ValueError(f"measure is one of {MEASURES}")
    known = F.when(F.col(measure) >= 0, F.col(measure))
    return entries.groupBy(*keys).agg(F.sum(known).alias("bytes"), F.max(known).alias("largest"), F.count(known).alias("known"))

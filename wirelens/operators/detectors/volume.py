"""Number of requests of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.counts import request_counts
from wirelens.operators.detectors.shape import finding


def volume(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    return finding(request_counts(entries, ["capture_id"]), "volume", "requests", count=F.col("requests"))

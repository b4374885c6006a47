"""Peak number of requests in flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.concurrency import peak_concurrency
from wirelens.operators.detectors.shape import finding


def ceiling(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    return finding(peak_concurrency(entries, ["capture_id"]), "ceiling", "peak", count=F.col("peak"))

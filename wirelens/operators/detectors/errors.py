"""Requests whose status tells a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.detectors.shape import MOST_EVIDENCE, finding, with_evidence


def failed(entries: DataFrame) -> DataFrame:
    """Every failed request; an unknown status is none."""
    return entries.where("status >= 400")


def errors(entries: DataFrame, pages: DataFrame | None = None, most: int = MOST_EVIDENCE) -> DataFrame:
    """A finding per capture, of 0 if none failed."""
    counted = entries.groupBy("capture_id").agg(F.count_if(F.col("status") >= 400).alias("n"))
    return finding(with_evidence(counted, failed(entries), most=most), "errors", "failed", count=F.col("n"), evidence=F.col("at"))

"""Serial chains: stretches of time in which requests overlap or touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.prefix import greatest_before
from wirelens.operators.detectors.shape import MOST_EVIDENCE, finding, hour, with_evidence


def stretch_starts(entries: DataFrame) -> DataFrame:
    """Every entry at whose start nothing before it is still in flight."""
    timed = entries.where("started is not null and duration is not null")
    timed = greatest_before(timed, ["capture_id"], ["started", "entry_ix"], F.col("started") + F.col("duration"), hour(), "_before")
    return timed.where(F.col("_before").isNull() | (F.col("started") > F.col("_before"))).drop("_before")


def chains(entries: DataFrame, pages: DataFrame | None = None, most: int = MOST_EVIDENCE) -> DataFrame:
    """The number of stretches, with the entries that begin them."""
    first = stretch_starts(entries)
    counted = first.groupBy("capture_id").agg(F.count("*").alias("n"))
    return finding(with_evidence(counted, first, most=most), "chains", "stretches", count=F.col("n"), evidence=F.col("at"))

"""Waves of requests: a wave begins where the gap since the last start exceeds a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.prefix import greatest_before
from wirelens.operators.detectors.shape import MOST_EVIDENCE, finding, hour, with_evidence


def wave_starts(entries: DataFrame, limit: str = "INTERVAL '1' HOUR") -> DataFrame:
    """Every entry that begins a wave. A gap of exactly the limit begins none."""
    marked = greatest_before(entries.where("started is not null"), ["capture_id"], ["started", "entry_ix"], F.col("started"), hour(), "_last").withColumn("_gap", F.col("started") - F.col("_last"))
    return marked.where(F.col("_gap").isNull() | (F.col("_gap") > F.expr(limit))).drop("_last", "_gap")


def waves(entries: DataFrame, pages: DataFrame | None = None, limit: str = "INTERVAL '1' HOUR", most: int = MOST_EVIDENCE) -> DataFrame:
    """The number of waves, with the entries that begin them."""
    first = wave_starts(entries, limit)
    counted = first.groupBy("capture_id").agg(F.count("*").alias("n"))
    return finding(with_evidence(counted, first, most=most), "waves", "waves", count=F.col("n"), evidence=F.col("at"))

"""The three largest bodies of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.operators.detectors.shape import finding


def heaviest(entries: DataFrame, pages: DataFrame | None = None, top: int = 3) -> DataFrame:
    """A finding per entry; of equal sizes the earlier entry comes first. Each task sends ``top`` entries of a capture at most."""
    order = W.partitionBy("capture_id").orderBy(F.col("content_bytes").desc(), "entry_ix")
    best = entries.where("content_bytes is not null").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return finding(best, "heaviest", "content_bytes", count=F.col("content_bytes"), evidence=F.array("entry_ix"))

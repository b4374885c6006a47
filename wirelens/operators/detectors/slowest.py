"""Longest request of a capture, with the entries that took as long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.operators.detectors.shape import MOST_EVIDENCE, finding, same


def longest(entries: DataFrame) -> DataFrame:
    """Every entry that took as long as the longest of its capture: capture_id, entry_ix."""
    most = entries.where("duration is not null").groupBy("capture_id").agg(F.max("duration").alias("duration"))
    return entries.alias("l").join(most.alias("r"), same(("capture_id",)) & (F.col("l.duration") == F.col("r.duration"))).select("l.capture_id", "l.entry_ix")


def slowest(entries: DataFrame, pages: DataFrame | None = None, most: int = MOST_EVIDENCE) -> DataFrame:
    """A finding per capture with a measured request. Each task sends ``most`` entries of a capture at most."""
    order = W.partitionBy("capture_id").orderBy(F.col("duration").desc(), "entry_ix")
    top = entries.where("duration is not null").select("capture_id", "duration", "entry_ix", F.row_number().over(order).alias("_r")).where(F.col("_r") <= most)
    found = top.groupBy("capture_id").agg(F.max("duration").alias("longest"), F.collect_list(F.struct("duration", "entry_ix")).alias("held"))
    at = F.sort_array(F.transform(F.filter("held", lambda x: x["duration"] == F.col("longest")), lambda x: x["entry_ix"]))
    return finding(found, "slowest", "longest", duration=F.col("longest"), evidence=at)

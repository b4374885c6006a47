"""Idle time: no request in flight between the first start and the last end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.prefix import greatest_before
from wirelens.operators.detectors.shape import finding, hour


def idle(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    timed = entries.where("started is not null and duration is not null")
    timed = greatest_before(timed, ["capture_id"], ["started", "entry_ix"], F.col("started") + F.col("duration"), hour(), "_before")
    gap = F.greatest(F.expr("INTERVAL '0' SECOND"), F.col("started") - F.col("_before"))
    return finding(timed.groupBy("capture_id").agg(F.coalesce(F.sum(gap), F.expr("INTERVAL '0' SECOND")).alias("idle")), "idle", "idle", duration=F.col("idle"))

"""Bytes of the response bodies of a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.counts import payload_bytes
from wirelens.operators.detectors.shape import finding


def payload(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    return finding(payload_bytes(entries, ["capture_id"], "content_bytes"), "payload", "content_bytes", count=F.col("bytes"))

"""The routes from captures to findings, run records and comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens import operators as ops
from wirelens.operators.detectors import DECLARED, Detector, detect
from wirelens.operators.records import metrics
from wirelens.sources import history


@dataclass
class Analysis:
    captures: DataFrame
    entries: DataFrame
    pages: DataFrame | None
    findings: DataFrame


def analyse(spark: SparkSession, path: str, label: str = "capture", detectors: tuple[Detector, ...] = DECLARED) -> Analysis:
    """Read the captures at ``path`` (see ``wirelens.session.configure``), normalise and detect."""
    captures, entries, pages = ops.normalise(lambda: spark.read.format("har").option("capture_id", label).option("pushdown", "true").load(path))
    return Analysis(captures, entries, pages, detect(entries, pages, detectors))


def count_metrics(entries: DataFrame) -> DataFrame:
    """Count facts of each capture: (capture_id, metric, value)."""
    key = ["capture_id"]
    requests = metrics(ops.request_counts(entries, key), ["requests", "unmeasured"], "requests")
    sizes = metrics(ops.payload_bytes(entries, key, "content_bytes"), ["bytes", "largest", "known"], "content")
    peak = metrics(ops.peak_concurrency(entries, key).withColumn("peak", F.col("peak").cast("long")), ["peak"], "concurrency")
    return requests.unionByName(sizes).unionByName(peak).where("value is not null")


def duration_metrics(entries: DataFrame) -> DataFrame:
    """Duration facts of each capture: (capture_id, metric, value)."""
    return metrics(ops.duration_stats(entries, ["capture_id"]), ["total", "longest", "p50", "p95"], "duration").where("value is not null")


def records(done: Analysis, environment: str) -> DataFrame:
    return ops.run_records(done.captures, count_metrics(done.entries), duration_metrics(done.entries), done.findings, environment)


def compare_runs(spark: SparkSession, path: str, base: str, candidate: str, on_mismatch: str = "refuse") -> DataFrame:
    return ops.compare(history.read(spark, path), base, candidate, on_mismatch)

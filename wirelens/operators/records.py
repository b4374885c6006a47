"""Run records: the small derived rows that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens import ANALYZER_VERSION, SCHEMA_VERSION
from wirelens.schema import RUN_RECORDS


def metrics(capture: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """A capture's metric columns as rows: capture_id, metric, value."""
    return capture.select("capture_id", *(F.col(n).alias(f"{prefix}.{n}") for n in names)).unpivot("capture_id", [f"`{prefix}.{n}`" for n in names], "metric", "value")


def run_records(captures: DataFrame, counts: DataFrame, durations: DataFrame, findings: DataFrame, environment: str, run_prefix: str = "") -> DataFrame:
    """One record a capture in the allowed shape alone.

    ``counts`` and ``durations`` are (capture_id, metric, value), ``findings``
    as detectors give them. The run's id is the caller's label of the capture.
    Metric names come from code, never from a capture.
    """
    pack = lambda df, name, *fields: df.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = captures.join(pack(counts, "counts", "metric", F.col("value").cast("long").alias("value")), "capture_id", "left")
    joined = joined.join(pack(durations, "durations", "metric", "value"), "capture_id", "left")
    joined = joined.join(pack(findings, "findings", "detector", "metric", "value_count", "value_duration", "evidence"), "capture_id", "left")
    wide = joined.select(
        F.concat(F.lit(run_prefix), "capture_id").alias("run_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ANALYZER_VERSION).alias("analyzer_version"), F.lit(environment).alias("environment"), "parse_status",
        *(F.coalesce(n, F.array().cast(RUN_RECORDS[n].dataType)).alias(n) for n in ("counts", "durations", "findings")),
    )
    return wide.select(*(F.col(f.name).cast(f.dataType) for f in RUN_RECORDS))

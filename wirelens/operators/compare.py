"""Comparison of two runs of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exploded(runs: DataFrame) -> DataFrame:
    """Metrics of runs as rows: the run's stamps, kind, metric, and the value in the column of its kind."""
    stamps = ["run_id", "schema_version", "analyzer_version", "environment", "parse_status"]
    counts = runs.select(*stamps, F.explode("counts").alias("m")).select(*stamps, F.lit("count").alias("kind"), "m.metric", F.col("m.value").alias("value_count"))
    spans = runs.select(*stamps, F.explode("durations").alias("m")).select(*stamps, F.lit("duration").alias("kind"), "m.metric", F.col("m.value").alias("value_duration"))
    return counts.unionByName(spans, allowMissingColumns=True)


def compare(history: DataFrame, base: str, candidate: str, on_mismatch: str = "refuse") -> DataFrame:
    """Every metric of either run: both values, delta and status.

    Status, the first that holds: ``ambiguous`` where the history holds
    records of either run id with different stamps or metrics (equal ones count once, and of different
    ones each metric's greatest value is shown); ``refused`` or ``flagged`` where the
    analyzer versions differ (``on_mismatch``), ``refused`` where schemas do;
    ``missing`` where a side has no such metric; ``truncated`` where a side's
    capture is not complete, so that its counts are lower bounds;
    ``environment`` for durations of different environments. A delta is given
    with ``ok`` and ``flagged`` alone.
    """
    if on_mismatch not in ("refuse", "flag"):
        raise ValueError("on_mismatch is 'refuse' or 'flag'")
    # The run's stamps are read by themselves, as a run may have no metric to carry them.
    stamps = history.where(F.col("run_id").isin(base, candidate)).select("run_id", "schema_version", "analyzer_version", "environment", "parse_status", F.xxhash64("schema_version", "analyzer_version", "environment", "parse_status", "counts", "durations").alias("record"))
    pick = lambda run, name, of=F.max: of(F.when(F.col("run_id") == run, F.col(name)))
    names = ("schema_version", "analyzer_version", "environment", "parse_status")
    several = (F.coalesce(pick(run, "record", F.min) != pick(run, "record"), F.lit(False)).alias(f"{s}_several") for run, s in ((base, "a"), (candidate, "b")))
    pair = stamps.agg(*(pick(base, n).alias(f"a_{n}") for n in names), *(pick(candidate, n).alias(f"b_{n}") for n in names), *several)
    side = lambda run, s: exploded(history.where(F.col("run_id") == run)).groupBy("kind", "metric").agg(F.max("value_count").alias(f"{s}_count"), F.max("value_duration").alias(f"{s}_duration"))
    both = side(base, "base").join(side(candidate, "candidate"), ["kind", "metric"], "full").join(F.broadcast(pair))  # one row
    differ = lambda n: ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}"))
    gone = lambda s: F.col(f"{s}_count").isNull() & F.col(f"{s}_duration").isNull()
    status = (
        F.when(F.col("a_several") | F.col("b_several"), "ambiguous")
        .when(differ("schema_version"), "refused")
        .when(differ("analyzer_version") & F.lit(on_mismatch == "refuse"), "refused")
        .when(gone("base") | gone("candidate"), "missing")
        .when((F.col("a_parse_status") != "complete") | (F.col("b_parse_status") != "complete"), "truncated")
        .when((F.col("kind") == "duration") & differ("environment"), "environment")
        .when(differ("analyzer_version"), "flagged")
        .otherwise("ok")
    )
    done = both.withColumn("status", status)
    told = F.col("status").isin("ok", "flagged")
    return done.select(
        "kind", "metric", "base_count", "candidate_count", F.when(told, F.col("candidate_count") - F.col("base_count")).alias("delta_count"),
        "base_duration", "candidate_duration", F.when(told, F.col("candidate_duration") - F.col("base_duration")).alias("delta_duration"), "status",
    )

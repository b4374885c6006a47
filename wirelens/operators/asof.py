"""As-of joins, and the baseline that a run is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.functions.prefix import greatest_before


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str], chunk: Column, name: str = "prior") -> DataFrame:
    """``left`` with ``name``: a struct of ``at`` and ``value`` of the latest row of ``right`` that has the same keys and an earlier ``at``; null if there is none.

    Of rows at the same instant that with the greatest values counts; null
    keys are a key; rows of ``right`` without an ``at`` are never the latest,
    and rows of ``left`` without one have none before them. Both sides are put
    in one order, and each row takes the last value before it, chunk by chunk
    (``chunk``, of ``at``, must not fall as it rises), so that no key is in one
    task and no pairs are made.
    """
    own = left.select(F.struct(*left.columns).alias("row"), *keys, at, F.lit(0).alias("side"), F.lit(None).cast(right.select(F.struct(at, *value)).schema[0].dataType).alias("given"))
    # At one instant the left side comes first: only earlier rows count.
    other = right.where(F.col(at).isNotNull()).select(F.lit(None).cast(own.schema["row"].dataType).alias("row"), *keys, at, F.lit(1).alias("side"), F.struct(at, *value).alias("given"))
    both = greatest_before(own.unionByName(other), keys, [at, "side"], F.col("given"), chunk, name)
    prior = F.when(F.col(f"row.{at}").isNotNull(), F.col(name))
    return both.where("side = 0").select("row.*", prior.alias(name))


def baselines(runs: DataFrame) -> DataFrame:
    """run_id, baseline: for each run the latest earlier complete run of the same analyzer version, schema version and environment; null if there is none.

    ``runs`` has run_id, started, schema_version, analyzer_version, environment
    and parse_status. Of runs that started at once the one with the greatest id
    counts.
    """
    same = ["schema_version", "analyzer_version", "environment"]
    found = latest_before(runs.select("run_id", "started", *same), runs.where("parse_status = 'complete'"), same, "started", ["run_id"], F.floor(F.unix_seconds("started") / 86400))
    return found.select("run_id", F.col("prior.run_id").alias("baseline"))

"""Duration facts: total, longest and exact percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.columns import duration_from_micros, micros
from wirelens.functions.prefix import running_total


def _name(q: float) -> str:
    return f"p{q * 100:g}".replace(".", "_")


def duration_stats(entries: DataFrame, keys: list[str], quantiles: tuple[float, ...] = (0.5, 0.95), chunk_seconds: int = 60) -> DataFrame:
    """By ``keys``: measured, total, longest and a column for each quantile, all but the first as durations.

    Quantiles are exact, interpolated linearly between neighbours. Equal
    durations are counted together, the counts run up in order of duration by
    chunks, and the two neighbours of each rank picked; so no task holds all
    durations of a key, as a built-in exact percentile would.
    """
    timed = entries.where("duration is not null").withColumn("us", micros("duration"))
    counts = timed.groupBy(*keys, "us").agg(F.count("*").alias("n"))
    ranked = running_total(counts, keys, "us", "n", F.floor(F.col("us") / F.lit(chunk_seconds * 1_000_000)), "upto")
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("measured"), F.sum(F.col("us") * F.col("n")).alias("total"), F.max("us").alias("longest"))
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    both = ranked.alias("r").join(whole.alias("w"), on) if keys else ranked.alias("r").join(whole.alias("w"))
    both = both.select("r.*", "w.measured", "w.total", "w.longest")
    picks = []
    for q in quantiles:
        rank = F.lit(q) * (F.col("measured") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.min(F.when(F.col("upto") > at, F.col("us"))).alias(f"{_name(q)}_{side}"))
    out = both.groupBy(*keys).agg(F.max("measured").alias("measured"), F.max("total").alias("total"), F.max("longest").alias("longest"), *picks)
    mixed = []
    for q in quantiles:
        rank = F.lit(q) * (F.col("measured") - 1)
        low, high = F.col(f"{_name(q)}_lo"), F.col(f"{_name(q)}_hi")
        mixed.append(duration_from_micros(F.round(low + (high - low) * (rank - F.floor(rank)))).alias(_name(q)))
    return out.select(*keys, "measured", duration_from_micros(F.col("total")).alias("total"), duration_from_micros(F.col("longest")).alias("longest"), *mixed)

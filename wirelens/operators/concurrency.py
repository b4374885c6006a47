"""Concurrency ceilings: the most requests in flight at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.columns import end_of
from wirelens.functions.prefix import running_total


def edges(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Net change of the number in flight by keys and instant. Intervals are half-open; entries of no or unknown duration have none."""
    timed = entries.where("started is not null and duration > INTERVAL '0' SECOND")
    sides = timed.select(*keys, F.explode(F.array(F.struct(F.col("started").alias("t"), F.lit(1).alias("d")), F.struct(end_of().alias("t"), F.lit(-1).alias("d")))).alias("e"))
    return sides.groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("net"))


def in_flight(entries: DataFrame, keys: list[str], chunk_seconds: int = 3600) -> DataFrame:
    """Number in flight from each instant on at which it may change."""
    chunk = F.floor(F.unix_seconds("t") / F.lit(chunk_seconds))
    return running_total(edges(entries, keys), keys, "t", "net", chunk, "flying")


def peak_concurrency(entries: DataFrame, keys: list[str], chunk_seconds: int = 3600) -> DataFrame:
    """Peak number in flight by ``keys``.

    A sweep over instants: as intervals are half-open, ends and starts at one
    instant net out, so the plan sums them first and then runs totals chunk by
    chunk of time. No overlap join, and no key in one task.
    """
    return in_flight(entries, keys, chunk_seconds).groupBy(*keys).agg(F.max("flying").alias("peak"))

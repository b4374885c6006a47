"""Interval joins: pairs of entries, or of entries and pages, that overlap in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key and bin that a task pairs at most; a bin with more is split into parts.
MOST_IN_BIN = 4096
#: So many split bins are broadcast at most; beyond that they are joined by a shuffle.
MOST_SPLIT = 1 << 17


def _binned(df: DataFrame, keys: list[str], names: dict[str, Column], bin_seconds: int) -> DataFrame:
    """Intervals (a: start, z: end, in microseconds) of more than no length, a row for each bin of time that they touch."""
    length = F.lit(bin_seconds * 1_000_000)
    rows = df.select(*keys, *(c.alias(n) for n, c in names.items())).where("a is not null and z > a")
    return rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / length), F.floor((F.col("z") - 1) / length))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, bin_seconds: int = 3600) -> DataFrame:
    """keys, left_id, right_id, overlap: every pair of the same keys whose intervals [started, started + duration) overlap, and for how long.

    Both sides have ``keys``, their id, ``started`` and ``duration``. Rows
    without a start, or of no or unknown duration, overlap nothing; null keys
    match nothing. Intervals are dealt to the bins of time that they touch,
    and a pair is reported from the bin that holds the later start alone, so
    nothing is compared outside a bin and no pair is given twice. A bin with
    many rows of a key on the left is split: each part meets all of the
    right's rows there. Choose bins about as long as usual intervals.
    """
    micros = F.unix_micros("started")
    ends = {"a": micros, "z": F.unix_micros(F.col("started") + F.col("duration"))}
    one = _binned(left, keys, {"left_id": F.col(left_id), **ends}, bin_seconds)
    two = _binned(right, keys, {"right_id": F.col(right_id), **ends}, bin_seconds)
    at = [*keys, "bin"]
    split = one.groupBy(*at).agg(F.ceil(F.count("*") / MOST_IN_BIN).alias("parts")).where("parts > 1")
    split = F.broadcast(split) if split.count() <= MOST_SPLIT else split
    parts = F.coalesce("parts", F.lit(1))
    one = one.join(split, at, "left").withColumn("part", F.pmod(F.xxhash64("left_id", "a", "z"), parts)).drop("parts")
    two = two.join(split, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    both = one.join(two.withColumnsRenamed({"a": "a2", "z": "z2"}), [*at, "part"])
    start, end = F.greatest("a", "a2"), F.least("z", "z2")
    met = both.where((start < end) & (F.floor(start / F.lit(bin_seconds * 1_000_000)) == F.col("bin")))
    length = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((end - start) / F.lit(1_000_000)).cast("decimal(18,6)"))
    return met.select(*keys, F.col("left_id").alias(left_id), F.col("right_id").alias(right_id if right_id != left_id else f"{right_id}_2"), length.alias("overlap"))

"""Running totals that don't put a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, keys: list[str], order: str, value: str, chunk: Column, name: str = "running") -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of the same keys up to and including this one, in order of ``order``.

    ``order`` must be unique within the keys, and ``chunk`` must not fall as
    it rises. Each chunk is summed by itself; the chunks' totals, a row a
    chunk, are then summed along the key. So a hot key is spread over as many
    tasks as it has chunks.
    """
    df = df.withColumn("_chunk", chunk)
    within = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = _carried(df, keys, F.sum(value), F.sum("_total"))
    return joined.withColumn(name, F.coalesce("_base", F.lit(0)) + F.sum(value).over(within)).drop("_base", "_chunk")


def greatest_before(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, name: str) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the rows of the same keys before this one, in order of ``order``; null at the first.

    ``chunk`` must not fall as the order rises; a hot key is spread over its
    chunks as in ``running_total``.
    """
    df = df.withColumn("_chunk", chunk)
    within = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = _carried(df, keys, F.max(value), F.max("_total"))
    return joined.withColumn(name, F.greatest("_base", F.max(value).over(within))).drop("_base", "_chunk")


def _carried(df: DataFrame, keys: list[str], total: Column, over: Column) -> DataFrame:
    """Rows with what the chunks before theirs come to (``_base``), a row a chunk being summed along the key."""
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_chunk").agg(total.alias("_total"))
    base = totals.withColumn("_base", over.over(before)).drop("_total")
    on = F.lit(True)
    for k in (*keys, "_chunk"):
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(base.alias("r"), on).select("l.*", "r._base")

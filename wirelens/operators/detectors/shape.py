"""How detectors state what they find."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.schema import FINDINGS

#: A finding holds so many ordinals at most, the first ones, since a capture may be of any size; its value counts all, and ``evidence_rows`` gives all as a table.
#: From 1,000 on, Spark no longer cuts the rows down before it shuffles them.
MOST_EVIDENCE = 999


def finding(df: DataFrame, detector: str, metric: str, count: Column | None = None, duration: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """Findings of ``df``, one a row; evidence is an array of entry ordinals."""
    given = {"detector": F.lit(detector), "metric": F.lit(metric), "value_count": count, "value_duration": duration}
    ordinals = F.array() if evidence is None else F.transform(evidence, lambda x: F.struct(x.cast("int").alias("entry_ix")))
    columns = [F.col("capture_id")] + [(F.lit(None) if c is None else c).cast(FINDINGS[name].dataType).alias(name) for name, c in given.items()]
    return df.select(*columns, ordinals.cast(FINDINGS["evidence"].dataType).alias("evidence"))


def with_evidence(values: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("capture_id",), most: int = MOST_EVIDENCE) -> DataFrame:
    """``values``, a row a group, with ``at``: the first ``most`` ordinals of the group's ``rows``. Each task sends ``most`` rows of a group at most."""
    order = W.partitionBy(*keys).orderBy("entry_ix")
    first = rows.select(*keys, "entry_ix", F.row_number().over(order).alias("_r")).where(F.col("_r") <= most)
    first = first.groupBy(*keys).agg(F.sort_array(F.collect_list("entry_ix")).alias("at"))
    return values.alias("l").join(first.alias("r"), same(keys), "left").select("l.*", F.coalesce("r.at", F.array().cast("array<int>")).alias("at"))


def same(keys: tuple[str, ...]) -> Column:
    """Whether the sides named l and r have the same keys; nulls are alike."""
    return reduce(Column.__and__, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))


def hour() -> Column:
    """The hour in which an entry starts: the chunks that a capture is ordered in."""
    return F.floor(F.unix_seconds("started") / F.lit(3600))

"""Requests that repeat method, host and path template with the same payload size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.detectors.shape import MOST_EVIDENCE, finding, same, with_evidence

SAME = ("capture_id", "method", "host", "path_template", "content_bytes")


def _groups(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with a host, and groups of two or more of them: their number and first ordinal."""
    known = entries.where("host is not null")
    return known, known.groupBy(*SAME).agg(F.count("*").alias("n"), F.min("entry_ix").alias("of")).where("n > 1")


def repeated(entries: DataFrame) -> DataFrame:
    """Every entry of a group: capture_id, entry_ix, of (the group's first ordinal). A group of any size is spread by the join, not gathered."""
    known, groups = _groups(entries)
    return known.alias("l").join(groups.alias("r"), same(SAME)).select("l.capture_id", "l.entry_ix", "r.of")


def duplicates(entries: DataFrame, pages: DataFrame | None = None, most: int = MOST_EVIDENCE) -> DataFrame:
    """A finding per group of two or more: its number of requests. Entries without a host belong to none."""
    known, groups = _groups(entries)
    return finding(with_evidence(groups, known, SAME, most), "duplicates", "repeats", count=F.col("n"), evidence=F.col("at"))

"""The contract of captures, entries and pages, from the rows of the capture source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.functions.columns import duration_from_millis
from wirelens.schema import PHASES


def _known(size: str):
    """Sizes are null where not available, which captures write as -1."""
    return F.when(F.col(size) >= 0, F.col(size)).alias(size)


def normalise(raw: DataFrame | Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(captures, entries, pages). A value that can't be read is null and its row stays.

    The source gives rows before a capture is read to its end, so entries find
    the ordinal of their page (the first of that name) here. ``raw`` may be a
    function that loads the rows: each part then loads them for itself, so
    that the source can apply the part's own filter.
    """
    load = raw if callable(raw) else lambda: raw
    started = F.try_to_timestamp("started").alias("started")
    places = load().where("kind = 'page'").where("page_key is not null").groupBy("capture_id", "page_key").agg(F.min("ix").alias("page_ix"))
    entries = load().where("kind = 'entry'").join(places, ["capture_id", "page_key"], "left").select(
        "capture_id", F.col("ix").alias("entry_ix"), "page_ix", started, duration_from_millis(F.col("time_ms")).alias("duration"), "method", "host", "path_template",
        F.when(F.col("status") > 0, F.col("status")).alias("status"), "mime_class", _known("request_body_bytes"), _known("response_body_bytes"), _known("content_bytes"),
        F.struct(*(duration_from_millis(F.col("phases_ms")[p]).alias(p) for p in PHASES)).alias("phases"),
    )
    pages = load().where("kind = 'page'").select(
        "capture_id", F.col("ix").alias("page_ix"), started, duration_from_millis(F.col("on_content_load_ms")).alias("on_content_load"), duration_from_millis(F.col("on_load_ms")).alias("on_load")
    )
    count = lambda kind: F.count_if(F.col("kind") == kind)
    captures = load().groupBy("capture_id").agg(
        F.max("har_version").alias("har_version"), count("entry").alias("n_entries"), count("page").alias("n_pages"),
        F.max_by("parse_status", F.when(F.col("kind") == "capture", F.lit(1)).otherwise(0)).alias("parse_status"),
    )
    return captures, entries, pages

"""Operators on entry tables: DataFrames in, DataFrames out."""

from wirelens.operators.asof import baselines, latest_before
from wirelens.operators.compare import compare
from wirelens.operators.concurrency import peak_concurrency
from wirelens.operators.counts import payload_bytes, request_counts
from wirelens.operators.durations import duration_stats
from wirelens.operators.intervals import overlaps
from wirelens.operators.normalise import normalise
from wirelens.operators.records import run_records

__all__ = ["baselines", "compare", "duration_stats", "latest_before", "normalise", "overlaps", "payload_bytes", "peak_concurrency", "request_counts", "run_records"]

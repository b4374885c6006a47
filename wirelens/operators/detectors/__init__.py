"""Detectors: functions of (entries, pages) to findings, one file each.

A finding is a code, a number and evidence by ordinal. It tells the shape of
a capture, never an intent or a cause, and holds no text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.operators.detectors.ceiling import ceiling
from wirelens.operators.detectors.chains import chains, stretch_starts
from wirelens.operators.detectors.duplicates import duplicates, repeated
from wirelens.operators.detectors.errors import errors, failed
from wirelens.operators.detectors.heaviest import heaviest
from wirelens.operators.detectors.idle import idle
from wirelens.operators.detectors.payload import payload
from wirelens.operators.detectors.slowest import longest, slowest
from wirelens.operators.detectors.volume import volume
from wirelens.operators.detectors.waves import wave_starts, waves

Detector = Callable[[DataFrame, DataFrame | None], DataFrame]

#: The first four measure the declared facts; the others are extensions.
DECLARED: tuple[Detector, ...] = (volume, payload, ceiling, slowest)
EXTENSIONS: tuple[Detector, ...] = (duplicates, waves, chains, idle, errors, heaviest)


def detect(entries: DataFrame, pages: DataFrame | None = None, detectors: tuple[Detector, ...] = DECLARED) -> DataFrame:
    """All findings of the detectors."""
    return reduce(DataFrame.unionByName, (d(entries, pages) for d in detectors))


def evidence_rows(entries: DataFrame) -> DataFrame:
    """All evidence, without a limit: capture_id, detector, entry_ix, of, a row each.

    ``of`` is the first ordinal of the finding that a row belongs to, for
    duplicates, of which a capture may have many findings; null for errors,
    waves, chains and slowest, of which it has one.
    """
    none = F.lit(None).cast("int")
    found = {"errors": failed(entries), "waves": wave_starts(entries), "chains": stretch_starts(entries), "slowest": longest(entries)}
    rows = [rows.select("capture_id", F.lit(name).alias("detector"), "entry_ix", none.alias("of")) for name, rows in found.items()]
    return reduce(DataFrame.unionByName, [*rows, repeated(entries).select("capture_id", F.lit("duplicates").alias("detector"), "entry_ix", F.col("of").cast("int").alias("of"))])

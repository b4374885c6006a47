"""Schemas. Counts are BIGINT and durations INTERVAL DAY TO SECOND, so that Spark's analyzer refuses to mix them."""

from __future__ import annotations

from pyspark.sql import types as T

DURATION = T.DayTimeIntervalType()
PHASES = ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


#: What the capture source gives: one row a capture, page or entry, with allowed fields only. A capture's row alone has its status and version.
RAW = _struct(
    ("capture_id", T.StringType()), ("kind", T.StringType()), ("ix", T.IntegerType()), ("parse_status", T.StringType()), ("har_version", T.StringType()),
    ("page_key", T.LongType()), ("started", T.StringType()), ("time_ms", T.DoubleType()), ("method", T.StringType()), ("host", T.StringType()), ("path_template", T.StringType()),
    ("status", T.IntegerType()), ("mime_class", T.StringType()), ("request_body_bytes", T.LongType()), ("response_body_bytes", T.LongType()), ("content_bytes", T.LongType()),
    ("phases_ms", T.MapType(T.StringType(), T.DoubleType())), ("on_content_load_ms", T.DoubleType()), ("on_load_ms", T.DoubleType()),
)

CAPTURES = _struct(("capture_id", T.StringType()), ("har_version", T.StringType()), ("n_entries", T.LongType()), ("n_pages", T.LongType()), ("parse_status", T.StringType()))

ENTRIES = _struct(
    ("capture_id", T.StringType()), ("entry_ix", T.IntegerType()), ("page_ix", T.IntegerType()), ("started", T.TimestampType()), ("duration", DURATION), ("method", T.StringType()),
    ("host", T.StringType()), ("path_template", T.StringType()), ("status", T.IntegerType()), ("mime_class", T.StringType()), ("request_body_bytes", T.LongType()),
    ("response_body_bytes", T.LongType()), ("content_bytes", T.LongType()), ("phases", _struct(*((p, DURATION) for p in PHASES))),
)

PAGES = _struct(("capture_id", T.StringType()), ("page_ix", T.IntegerType()), ("started", T.TimestampType()), ("on_content_load", DURATION), ("on_load", DURATION))

EVIDENCE = T.ArrayType(_struct(("entry_ix", T.IntegerType())))
FINDINGS = _struct(("capture_id", T.StringType()), ("detector", T.StringType()), ("metric", T.StringType()), ("value_count", T.LongType()), ("value_duration", DURATION), ("evidence", EVIDENCE))

#: The only shape that is kept. It holds numbers, codes and ordinals; no host, path, header, title or text has a place in it.
RUN_RECORDS = _struct(
    ("run_id", T.StringType()), ("schema_version", T.IntegerType()), ("analyzer_version", T.StringType()), ("environment", T.StringType()), ("parse_status", T.StringType()),
    ("counts", T.ArrayType(_struct(("metric", T.StringType()), ("value", T.LongType())))),
    ("durations", T.ArrayType(_struct(("metric", T.StringType()), ("value", DURATION)))),
    ("findings", T.ArrayType(_struct(("detector", T.StringType()), ("metric", T.StringType()), ("value_count", T.LongType()), ("value_duration", DURATION), ("evidence", EVIDENCE)))),
)

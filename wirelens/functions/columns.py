"""URLs, durations and time, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROSECOND = "INTERVAL '0.000001' SECOND"


def micros(duration: str) -> Column:
    """A duration column as whole microseconds. A cast would cut it to seconds."""
    return F.expr(f"{duration} div {MICROSECOND}")


def duration_from_micros(count: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (count / F.lit(1_000_000)).cast("decimal(18,6)"))


def duration_from_millis(value: Column) -> Column:
    """A duration of milliseconds; null where not available, which captures write as -1."""
    return F.when((value >= 0) & (value < 1e13), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.round(value * 1000).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")))


def url_host(url: Column) -> Column:
    """Lower-case host; null for malformed URLs and for those that have none, such as data: and blob:."""
    return F.when(~F.lower(url).rlike("^(data|blob|about|javascript):"), F.lower(F.try_parse_url(url, F.lit("HOST"))))


def path_template(url: Column) -> Column:
    """Path with numbers replaced, without query and fragment."""
    return F.when(~F.lower(url).rlike("^(data|blob|about|javascript):"), F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "[0-9]+", "{n}"))


def end_of(started: str = "started", duration: str = "duration") -> Column:
    return F.col(started) + F.col(duration)

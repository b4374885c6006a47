"""Entry tables made of the driver's tables, which hold no captures: stand-ins that exercise the operators.

A row of ``events`` stands for an entry: ``ts`` is its start, ``value`` its
duration in minutes, the length of ``props`` its size, an error its failure.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.functions.columns import duration_from_micros, path_template, url_host
from wirelens.schema import ENTRIES, PHASES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, capture: str = "event_type", stream: bool = False) -> DataFrame:
    """The events as entries, ``capture`` being the column that names the capture; with ``stream``, as a stream of the table's files."""
    events = table(spark, sf_dir, "events")
    if stream:
        # As a pattern the path may be a file as well as a folder.
        events = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")
    micros = F.round(F.col("value") * 100).cast("long") * 600_000
    given = {
        "capture_id": F.col(capture).cast("string"), "entry_ix": F.col("event_id"), "started": F.col("ts").cast("timestamp"), "duration": F.when(micros >= 0, duration_from_micros(micros)),
        "method": F.lit("GET"), "host": F.col("event_type"), "path_template": F.col("user_id").cast("string"), "status": F.when(F.col("event_type") == "error", 500).otherwise(200),
        "mime_class": F.lit("json"), "content_bytes": F.length("props").cast("long"),
    }
    return events.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRIES))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of ``pages`` stands for an entry: its URL, and the bytes of its html as body."""
    pages = table(spark, sf_dir, "pages")
    given = {"capture_id": F.lit("pages"), "entry_ix": F.col("page_id"), "method": F.lit("GET"), "host": url_host(F.col("url")), "path_template": path_template(F.col("url")), "mime_class": F.lit("html"), "content_bytes": F.octet_length("html").cast("long")}
    return pages.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRIES))


def capture_text(rows: list[dict], cut: bool = False) -> str:
    """A synthetic capture of event rows; with ``cut``, the last entry is left half written."""
    made = []
    for r in rows:
        made.append({
            "pageref": "p0", "startedDateTime": r["ts"].isoformat() + "Z", "time": round(r["value"] * 100) * 600.0,
            "request": {"method": "GET", "url": f"https://{r['event_type']}.example.com/u/{r['user_id']}?k={r['event_id']}", "headers": [{"name": "Cookie", "value": "session=planted"}], "bodySize": -1},
            "response": {"status": 500 if r["event_type"] == "error" else 200, "content": {"size": len(r["props"]), "mimeType": "application/json", "text": r["props"]}, "bodySize": -1},
            "timings": dict.fromkeys(PHASES, -1),
        })
    page = {"id": "p0", "startedDateTime": rows[0]["ts"].isoformat() + "Z", "title": 'planted "entries": [', "pageTimings": {"onContentLoad": -1, "onLoad": -1}}
    text = json.dumps({"log": {"version": "1.2", "pages": [page], "entries": made}})
    return text[: text.rindex('"timings"')] if cut else text


#: Events of a capture: so a file, and the task that makes it, has a bound.
BLOCK = 4096


def write_captures(spark: SparkSession, sf_dir: str, folder: str, cut: bool = False) -> None:
    """The events of each type and block of ids as a capture file in ``folder``: one pass, each file written by the task that holds its block."""
    events = table(spark, sf_dir, "events").where("ts is not null and value is not null and props is not null")

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"t": [key[0]], "b": [key[1]], "value": [capture_text(rows.sort_by("event_id").to_pylist(), cut)]})

    # A text row and a folder a capture, so that files are in order of types and blocks.
    block = F.lpad(F.floor(F.col("event_id") / BLOCK).cast("string"), 12, "0")
    texts = events.withColumn("t", F.col("event_type")).withColumn("b", block).groupBy("t", "b").applyInArrow(made, "t string, b string, value string")
    texts.write.mode("overwrite").partitionBy("t", "b").text(folder)

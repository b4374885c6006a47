"""Registered queries of the capture operators over the driver's stand-in tables, and their SQL.

Durations leave as whole microseconds, since the two engines hash intervals
differently.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens import ANALYZER_VERSION
from wirelens import operators as ops
from wirelens.functions.columns import micros
from wirelens.operators import detectors as d
from wirelens.operators.compare import exploded
from wirelens.plans import standins
from wirelens.plans.analyse import count_metrics, duration_metrics
from wirelens.session import configure
from wirelens.sources import history
from wirelens.streaming.sessions import session_stream, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Entries of the events table in SQL, as the stand-ins make them.
ENTRIES_SQL = """
    e AS (SELECT {capture} AS capture_id, event_id AS ix, epoch_us(ts) AS st, CAST(round(value * 100) AS BIGINT) * 600000 AS us, event_type, user_id, CAST(length(props) AS BIGINT) AS size FROM events),
    t AS (SELECT *, st + us AS en FROM e)
"""


def query(sql: str | None = None, capture: str = "event_type") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{ENTRIES}", ENTRIES_SQL.format(capture=capture))
        return f

    return add


def _shared(spark: SparkSession) -> str:
    """The folder shared by driver and executors; a temporary one in sessions that set none, such as tests."""
    import tempfile

    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return f"{sc.getCheckpointDir()}/wirelens-{uuid.uuid4().hex}"


@query("""WITH {ENTRIES} SELECT capture_id, count(*) AS requests, count(*) FILTER (WHERE us IS NULL) AS unmeasured FROM e GROUP BY 1""")
def d4_request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.request_counts(standins.entries(spark, sf_dir), ["capture_id"])


@query("""WITH {ENTRIES} SELECT capture_id, user_id::VARCHAR AS path_template, count(*) AS requests, count(*) FILTER (WHERE us IS NULL) AS unmeasured FROM e GROUP BY 1, 2""")
def d4_counts_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.request_counts(standins.entries(spark, sf_dir), ["capture_id", "path_template"])


@query("""WITH {ENTRIES} SELECT capture_id, CAST(sum(size) AS BIGINT) AS bytes, max(size) AS largest, count(size) AS known FROM e GROUP BY 1""")
def d5_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.payload_bytes(standins.entries(spark, sf_dir), ["capture_id"], "content_bytes")


@query("""SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, max(octet_length(encode(html))) AS largest, count(html) AS known FROM pages GROUP BY 1""")
def d5_body_bytes_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.payload_bytes(standins.page_entries(spark, sf_dir), ["host"], "content_bytes")


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[0-9]+', '{n}', 'g') AS path_template FROM pages""")
def d3_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.page_entries(spark, sf_dir).select(F.col("entry_ix").cast("long").alias("page_id"), "host", "path_template")


PEAK_SQL = """
    WITH {ENTRIES}, edges AS (SELECT capture_id, st AS tm, 1 AS d FROM t WHERE us > 0 UNION ALL SELECT capture_id, en, -1 FROM t WHERE us > 0),
    run AS (SELECT capture_id, sum(d) OVER (PARTITION BY capture_id ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS flying FROM edges)
    SELECT capture_id, CAST(max(flying) AS BIGINT) AS peak FROM run GROUP BY 1
"""


@query(PEAK_SQL)
def d6_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peak_concurrency(standins.entries(spark, sf_dir), ["capture_id"])


@query(PEAK_SQL, "user_id::VARCHAR")
def d6_peak_concurrency_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.peak_concurrency(standins.entries(spark, sf_dir, "user_id"), ["capture_id"])


STATS_SQL = """
    WITH {ENTRIES} SELECT capture_id, count(us) AS measured, CAST(sum(us) AS BIGINT) AS total, max(us) AS longest,
    CAST(round(quantile_cont(us, 0.5)) AS BIGINT) AS p50, CAST(round(quantile_cont(us, 0.95)) AS BIGINT) AS p95 FROM e WHERE us IS NOT NULL GROUP BY 1
"""


def _stats(entries: DataFrame) -> DataFrame:
    return ops.duration_stats(entries, ["capture_id"]).select("capture_id", "measured", *(micros(c).alias(c) for c in ("total", "longest", "p50", "p95")))


@query(STATS_SQL)
def d7_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(standins.entries(spark, sf_dir))


@query(STATS_SQL, "user_id::VARCHAR")
def d7_duration_stats_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(standins.entries(spark, sf_dir, "user_id"))


def _findings(found: DataFrame) -> DataFrame:
    evidence = F.array_join(F.transform("evidence", lambda x: x["entry_ix"].cast("string")), ",")
    return found.select("capture_id", "detector", "metric", "value_count", micros("value_duration").alias("value_us"), evidence.alias("evidence"))


@query("""
    WITH {ENTRIES}, edges AS (SELECT capture_id, st AS tm, 1 AS d FROM t WHERE us > 0 UNION ALL SELECT capture_id, en, -1 FROM t WHERE us > 0),
    run AS (SELECT capture_id, sum(d) OVER (PARTITION BY capture_id ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS flying FROM edges),
    top AS (SELECT capture_id, ix, us, rank() OVER (PARTITION BY capture_id ORDER BY us DESC) AS r FROM e WHERE us IS NOT NULL)
    SELECT capture_id, 'volume' AS detector, 'requests' AS metric, count(*) AS value_count, CAST(NULL AS BIGINT) AS value_us, '' AS evidence FROM e GROUP BY 1
    UNION ALL SELECT capture_id, 'payload', 'content_bytes', CAST(sum(size) AS BIGINT), NULL, '' FROM e GROUP BY 1
    UNION ALL SELECT capture_id, 'ceiling', 'peak', CAST(max(flying) AS BIGINT), NULL, '' FROM run GROUP BY 1
    UNION ALL SELECT capture_id, 'slowest', 'longest', NULL, max(us), array_to_string(list(ix::VARCHAR ORDER BY ix)[1:999], ',') FROM top WHERE r = 1 GROUP BY 1
""")
def d8_declared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.detect(standins.entries(spark, sf_dir)))


@query("""
    WITH {ENTRIES} SELECT capture_id, 'duplicates' AS detector, 'repeats' AS metric, count(*) AS value_count, CAST(NULL AS BIGINT) AS value_us, array_to_string(list(ix::VARCHAR ORDER BY ix)[1:999], ',') AS evidence
    FROM e GROUP BY capture_id, event_type, user_id, size HAVING count(*) > 1
""")
def d8_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.duplicates(standins.entries(spark, sf_dir)))


@query("""
    WITH {ENTRIES}, g AS (SELECT *, st - lag(st) OVER (PARTITION BY capture_id ORDER BY st, ix) AS gap FROM e)
    SELECT capture_id, 'waves' AS detector, 'waves' AS metric, count(*) AS value_count, CAST(NULL AS BIGINT) AS value_us, array_to_string(list(ix::VARCHAR ORDER BY ix)[1:999], ',') AS evidence
    FROM g WHERE gap IS NULL OR gap > 3600000000 GROUP BY 1
""", "user_id::VARCHAR")
def d8_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.waves(standins.entries(spark, sf_dir, "user_id")))


@query("""
    WITH {ENTRIES}, g AS (SELECT *, max(en) OVER (PARTITION BY capture_id ORDER BY st, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE us IS NOT NULL)
    SELECT capture_id, 'chains' AS detector, 'stretches' AS metric, count(*) AS value_count, CAST(NULL AS BIGINT) AS value_us, array_to_string(list(ix::VARCHAR ORDER BY ix)[1:999], ',') AS evidence
    FROM g WHERE b IS NULL OR st > b GROUP BY 1
""", "user_id::VARCHAR")
def d8_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.chains(standins.entries(spark, sf_dir, "user_id")))


@query("""
    WITH {ENTRIES}, g AS (SELECT *, max(en) OVER (PARTITION BY capture_id ORDER BY st, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE us IS NOT NULL)
    SELECT capture_id, 'idle' AS detector, 'idle' AS metric, CAST(NULL AS BIGINT) AS value_count, CAST(coalesce(sum(greatest(0, st - b)), 0) AS BIGINT) AS value_us, '' AS evidence FROM g GROUP BY 1
""", "user_id::VARCHAR")
def d8_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.idle(standins.entries(spark, sf_dir, "user_id")))


@query("""
    WITH {ENTRIES} SELECT capture_id, 'errors' AS detector, 'failed' AS metric, count(*) FILTER (WHERE event_type = 'error') AS value_count, CAST(NULL AS BIGINT) AS value_us,
    coalesce(array_to_string((list(ix::VARCHAR ORDER BY ix) FILTER (WHERE event_type = 'error'))[1:999], ','), '') AS evidence FROM e GROUP BY 1
""", "user_id::VARCHAR")
def d8_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.errors(standins.entries(spark, sf_dir, "user_id")))


@query("""
    WITH {ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY size DESC, ix) AS r FROM e WHERE size IS NOT NULL)
    SELECT capture_id, 'heaviest' AS detector, 'content_bytes' AS metric, size AS value_count, CAST(NULL AS BIGINT) AS value_us, ix::VARCHAR AS evidence FROM r WHERE r <= 3
""", "user_id::VARCHAR")
def d8_heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(d.heaviest(standins.entries(spark, sf_dir, "user_id")))


@query("""
    WITH {ENTRIES}, g AS (SELECT *, st - lag(st) OVER w AS gap FROM e WINDOW w AS (PARTITION BY capture_id ORDER BY st, ix)),
    h AS (SELECT *, max(en) OVER (PARTITION BY capture_id ORDER BY st, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t WHERE us IS NOT NULL)
    SELECT capture_id, 'errors' AS detector, ix AS entry_ix, CAST(NULL AS BIGINT) AS "of" FROM e WHERE event_type = 'error'
    UNION ALL SELECT capture_id, 'waves', ix, NULL FROM g WHERE gap IS NULL OR gap > 3600000000
    UNION ALL SELECT capture_id, 'chains', ix, NULL FROM h WHERE b IS NULL OR st > b
    UNION ALL SELECT capture_id, 'slowest', ix, NULL FROM (SELECT *, max(us) OVER (PARTITION BY capture_id) AS most FROM e) WHERE us = most
    UNION ALL SELECT capture_id, 'duplicates', ix, first FROM (SELECT *, count(*) OVER w AS n, min(ix) OVER w AS first FROM e WINDOW w AS (PARTITION BY capture_id, event_type, user_id, size)) WHERE n > 1
""")
def d8_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.evidence_rows(standins.entries(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("entry_ix", "of")})


def _records(spark: SparkSession, sf_dir: str, environment: str = "test") -> DataFrame:
    entries = standins.entries(spark, sf_dir)
    captures = entries.groupBy("capture_id").agg(F.lit("1.2").alias("har_version"), F.count("*").alias("n_entries"), F.lit(0).cast("long").alias("n_pages"), F.lit("complete").alias("parse_status"))
    return ops.run_records(captures, count_metrics(entries), duration_metrics(entries), d.detect(entries), environment)


METRICS_SQL = """
    {ENTRIES}, edges AS (SELECT capture_id, st AS tm, 1 AS d FROM t WHERE us > 0 UNION ALL SELECT capture_id, en, -1 FROM t WHERE us > 0),
    run AS (SELECT capture_id, sum(d) OVER (PARTITION BY capture_id ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS flying FROM edges),
    w AS (SELECT capture_id, count(*) AS a, count(*) FILTER (WHERE us IS NULL) AS b, CAST(sum(size) AS BIGINT) AS c, max(size) AS d, count(size) AS f,
        CAST(sum(us) AS BIGINT) AS g, max(us) AS h, CAST(round(quantile_cont(us, 0.5)) AS BIGINT) AS i, CAST(round(quantile_cont(us, 0.95)) AS BIGINT) AS j FROM e GROUP BY 1),
    m AS (
        SELECT capture_id, 'count' AS kind, 'requests.requests' AS metric, a AS value FROM w UNION ALL SELECT capture_id, 'count', 'requests.unmeasured', b FROM w
        UNION ALL SELECT capture_id, 'count', 'content.bytes', c FROM w UNION ALL SELECT capture_id, 'count', 'content.largest', d FROM w UNION ALL SELECT capture_id, 'count', 'content.known', f FROM w
        UNION ALL SELECT capture_id, 'count', 'concurrency.peak', CAST(max(flying) AS BIGINT) FROM run GROUP BY 1
        UNION ALL SELECT capture_id, 'duration', 'duration.total', g FROM w UNION ALL SELECT capture_id, 'duration', 'duration.longest', h FROM w
        UNION ALL SELECT capture_id, 'duration', 'duration.p50', i FROM w UNION ALL SELECT capture_id, 'duration', 'duration.p95', j FROM w)
"""


@query("WITH " + METRICS_SQL + " SELECT capture_id AS run_id, 'test' AS environment, kind, metric, value FROM m")
def d9_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(_records(spark, sf_dir)).select("run_id", "environment", "kind", "metric", F.coalesce("value_count", micros("value_duration")).alias("value"))


@query("WITH " + METRICS_SQL + " SELECT capture_id AS run_id, 'test' AS environment, kind, metric, value FROM m")
def d9_history_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a history to which half of them were appended first, and then all."""
    folder = _shared(spark)
    made = _records(spark, sf_dir)
    history.append(made.where("run_id < 'm'"), folder)
    history.append(made, folder)
    return exploded(history.read(spark, folder)).select("run_id", "environment", "kind", "metric", F.coalesce("value_count", micros("value_duration")).alias("value"))


SESSIONS_SQL = """
    WITH {ENTRIES}, g AS (SELECT *, lag(st) OVER (PARTITION BY capture_id ORDER BY st, ix) AS before FROM e WHERE st IS NOT NULL),
    s AS (SELECT *, sum(CASE WHEN before IS NULL OR st - before >= {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY capture_id ORDER BY st, ix) AS k FROM g),
    f AS (SELECT capture_id, min(st) AS first_us, max(st) AS last_us, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY capture_id, k)
    SELECT * FROM f
"""


def _instants(found: DataFrame) -> DataFrame:
    return found.select("capture_id", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "requests", "bytes")


@query(SESSIONS_SQL.replace("{gap}", "7200000000"), "user_id::VARCHAR")
def d4_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a user's requests without a gap of two hours."""
    return _instants(sessions(standins.entries(spark, sf_dir, "user_id"), gap="2 hours"))


@query(SESSIONS_SQL.replace("{gap}", "7200000000") + " WHERE last_us + 7200000000 <= (SELECT max(st) FROM e) - 600000000", "user_id::VARCHAR")
def d4_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the table read as a stream: sessions that are over by the time its watermark reaches."""
    folder = _shared(spark)
    stream = session_stream(standins.entries(spark, sf_dir, "user_id", stream=True), gap="2 hours", late="10 minutes")
    run = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return _instants(spark.read.schema(stream.schema).parquet(f"{folder}/out"))


def _compared(df: DataFrame) -> DataFrame:
    value = lambda side: F.coalesce(f"{side}_count", micros(f"{side}_duration")).alias(side)
    return df.select("kind", "metric", value("base"), value("candidate"), value("delta"), "status")


COMPARE_SQL = "WITH " + METRICS_SQL + """
    SELECT kind, metric, a.value AS base, b.value AS candidate, CASE WHEN {told} THEN b.value - a.value END AS delta, {status} AS status
    FROM (SELECT kind, metric, value FROM m WHERE capture_id = 'click') a FULL JOIN (SELECT kind, metric, value FROM m WHERE capture_id = 'view') b USING (kind, metric)
"""


@query(COMPARE_SQL.replace("{told}", "true").replace("{status}", "'ok'"))
def d10_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(ops.compare(_records(spark, sf_dir), "click", "view"))


def _newer(records: DataFrame) -> DataFrame:
    return records.withColumn("analyzer_version", F.when(F.col("run_id") == "view", "2.0").otherwise(F.col("analyzer_version")))


@query(COMPARE_SQL.replace("{told}", "false").replace("{status}", "'refused'"))
def d11_version_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(ops.compare(_newer(_records(spark, sf_dir)), "click", "view"))


@query(COMPARE_SQL.replace("{told}", "true").replace("{status}", "'flagged'"))
def d11_version_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(ops.compare(_newer(_records(spark, sf_dir)), "click", "view", on_mismatch="flag"))


@query(COMPARE_SQL.replace("{told}", "false").replace("{status}", "'truncated'"))
def d10_compare_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side's capture was cut short."""
    records = _records(spark, sf_dir)
    cut = records.withColumn("parse_status", F.when(F.col("run_id") == "view", "truncated").otherwise(F.col("parse_status")))
    return _compared(ops.compare(cut, "click", "view"))


@query("WITH " + METRICS_SQL + " SELECT kind, metric, CASE WHEN kind = 'count' THEN value END AS base, CASE WHEN kind = 'duration' THEN value END AS candidate, CAST(NULL AS BIGINT) AS delta, 'missing' AS status FROM m WHERE capture_id = CASE WHEN kind = 'count' THEN 'click' ELSE 'view' END")
def d10_compare_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base has no durations, the candidate no counts."""
    records = _records(spark, sf_dir)
    none = lambda name, run: F.when(F.col("run_id") == run, F.array().cast(records.schema[name].dataType)).otherwise(F.col(name))
    return _compared(ops.compare(records.withColumns({"durations": none("durations", "click"), "counts": none("counts", "view")}), "click", "view"))


@query("WITH {ENTRIES}" + """, edges AS (SELECT capture_id, st AS tm, 1 AS d FROM t WHERE us > 0 UNION ALL SELECT capture_id, en, -1 FROM t WHERE us > 0),
    run AS (SELECT capture_id, sum(d) OVER (PARTITION BY capture_id ORDER BY tm, d ROWS UNBOUNDED PRECEDING) AS flying FROM edges),
    top AS (SELECT capture_id, ix, us, rank() OVER (PARTITION BY capture_id ORDER BY us DESC) AS r FROM e WHERE us IS NOT NULL),
    f AS (SELECT capture_id, 'volume' AS detector, 'requests' AS metric, count(*) AS value, '' AS evidence FROM e GROUP BY 1
        UNION ALL SELECT capture_id, 'payload', 'content_bytes', CAST(sum(size) AS BIGINT), '' FROM e GROUP BY 1
        UNION ALL SELECT capture_id, 'ceiling', 'peak', CAST(max(flying) AS BIGINT), '' FROM run GROUP BY 1
        UNION ALL SELECT capture_id, 'slowest', 'longest', max(us), array_to_string(list(ix::VARCHAR ORDER BY ix)[1:999], ',') FROM top WHERE r = 1 GROUP BY 1)
    SELECT capture_id AS run_id, 1 AS schema_version, '{analyzer}' AS analyzer_version, 'complete' AS parse_status, detector, metric, value, evidence FROM f
""".replace("{analyzer}", ANALYZER_VERSION))
def d9_record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that records hold, with the records' stamps."""
    found = _records(spark, sf_dir).select("run_id", "schema_version", "analyzer_version", "parse_status", F.explode("findings").alias("f"))
    evidence = F.array_join(F.transform("f.evidence", lambda x: x["entry_ix"].cast("string")), ",")
    value = F.coalesce("f.value_count", micros("f.value_duration"))
    return found.select("run_id", F.col("schema_version").cast("int").alias("schema_version"), "analyzer_version", "parse_status", "f.detector", "f.metric", value.alias("value"), evidence.alias("evidence"))


@query("""
    WITH {ENTRIES}, v AS (SELECT * FROM t WHERE event_type = 'view' AND us > 0)
    SELECT a.capture_id, a.ix AS entry_ix, v.ix AS page_ix, least(a.en, v.en) - greatest(a.st, v.st) AS overlap_us
    FROM t a JOIN v ON a.capture_id = v.capture_id AND a.st < v.en AND v.st < a.en WHERE a.event_type <> 'view' AND a.us > 0
""", "user_id::VARCHAR")
def d6_page_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's requests that are in flight while one of the user's views loads."""
    entries = standins.entries(spark, sf_dir, "user_id")
    pages = entries.where("host = 'view'").drop("page_ix").withColumnRenamed("entry_ix", "page_ix")
    found = ops.overlaps(entries.where("host <> 'view'"), pages, ["capture_id"], "entry_ix", "page_ix")
    return found.select("capture_id", F.col("entry_ix").cast("long").alias("entry_ix"), F.col("page_ix").cast("long").alias("page_ix"), micros("overlap").alias("overlap_us"))


@query("""
    WITH r AS (SELECT event_id, ts, event_type, user_id % 3 AS version, event_id % 5 <> 0 AS complete FROM events),
    c AS (SELECT event_type, version, ts, max(event_id) AS event_id FROM r WHERE complete AND ts IS NOT NULL GROUP BY ALL)
    SELECT r.event_id AS run_id, c.event_id AS baseline FROM r ASOF LEFT JOIN c ON r.event_type = c.event_type AND r.version = c.version AND r.ts > c.ts
""")
def d10_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs: the run that each would be compared with."""
    events = standins.table(spark, sf_dir, "events")
    runs = events.select(
        F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("started"), F.lit(1).alias("schema_version"), (F.col("user_id") % 3).cast("string").alias("analyzer_version"),
        F.col("event_type").alias("environment"), F.when(F.col("event_id") % 5 != 0, "complete").otherwise("truncated").alias("parse_status"),
    )
    return ops.baselines(runs)


@query(COMPARE_SQL.replace("{told}", "kind = 'count'").replace("{status}", "CASE WHEN kind = 'count' THEN 'ok' ELSE 'environment' END"))
def d12_environment_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    moved = records.withColumn("environment", F.when(F.col("run_id") == "view", "other").otherwise(F.col("environment")))
    return _compared(ops.compare(moved, "click", "view"))


def _parsed(spark: SparkSession, sf_dir: str, cut: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Captures, entries and pages of the stand-in captures, each of which is read and parsed once: all three are made of the source's rows, written as a table."""
    folder = _shared(spark)
    standins.write_captures(spark, sf_dir, f"{folder}/captures", cut)
    rows = configure(spark).read.format("har").option("capture_id", "c").load(f"{folder}/captures")
    rows.write.parquet(f"{folder}/rows")
    return ops.normalise(spark.read.schema(rows.schema).parquet(f"{folder}/rows"))


PARSED_SQL = """
    WITH x AS (SELECT *, dense_rank() OVER (ORDER BY event_type, event_id // 4096) - 1 AS k, row_number() OVER (PARTITION BY event_type, event_id // 4096 ORDER BY event_id DESC) AS back FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL)
    SELECT 'c-' || lpad(k::VARCHAR, 6, '0') AS capture_id, '{status}' AS parse_status, count(*) AS n_entries, 1::BIGINT AS n_pages, event_type || '.example.com' AS host, CAST(sum(length(props)) AS BIGINT) AS bytes,
    CAST(sum(CAST(round(value * 100) AS BIGINT) * 600000) AS BIGINT) AS total_us, min(ts) AS first_started FROM x WHERE {kept} GROUP BY k, event_type
"""


def _summary(captures: DataFrame, entries: DataFrame) -> DataFrame:
    sums = entries.groupBy("capture_id", "host").agg(F.sum("content_bytes").alias("bytes"), F.sum("duration").alias("d"), F.min("started").cast("timestamp_ntz").alias("first_started"))
    return captures.join(sums, "capture_id").select("capture_id", "parse_status", "n_entries", "n_pages", "host", "bytes", micros("d").alias("total_us"), "first_started")


@query(PARSED_SQL.replace("{status}", "complete").replace("{kept}", "true"))
def d1_parse_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries, _ = _parsed(spark, sf_dir, cut=False)
    return _summary(captures, entries)


@query(PARSED_SQL.replace("{status}", "truncated").replace("{kept}", "back > 1"))
def d2_parse_cut_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture is cut inside its last entry, which alone is lost."""
    captures, entries, _ = _parsed(spark, sf_dir, cut=True)
    return _summary(captures, entries)


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, bytes and peak concurrency of each capture."""
    entries = standins.entries(spark, sf_dir)
    return ops.request_counts(entries, ["capture_id"]).join(ops.payload_bytes(entries, ["capture_id"], "content_bytes"), "capture_id").join(ops.peak_concurrency(entries, ["capture_id"]), "capture_id", "left")

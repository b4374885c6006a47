import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from wirelens import operators as ops
from wirelens.functions.columns import micros
from wirelens.operators import detectors as d
from wirelens.schema import ENTRIES, RUN_RECORDS
from wirelens.streaming import windowed_counts

T0 = datetime(2024, 1, 1)


def table(spark, given):
    """Entries from (capture, start seconds, duration seconds or None, bytes)."""
    names = [f.name for f in ENTRIES]
    made = []
    for i, (capture, start, length, size) in enumerate(given):
        row = dict.fromkeys(names)
        row |= {"capture_id": capture, "entry_ix": i, "started": None if start is None else T0 + timedelta(seconds=start), "duration": None if length is None else timedelta(seconds=length), "content_bytes": size, "method": "GET", "host": "h", "path_template": f"/{size}", "status": 500 if size == 5 else 200}
        made.append(tuple(row[n] for n in names))
    return spark.createDataFrame(made, ENTRIES)


def brute_peak(given):
    out = {}
    for c, s, l, _ in given:
        if s is not None and l:
            out[c] = max(out.get(c, 0), sum(c2 == c and s2 is not None and bool(l2) and s2 <= s < s2 + l2 for c2, s2, l2, _ in given))
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk", [1, 7, 3600])
def test_peak_equals_brute_force(spark, seed, chunk):
    rng = random.Random(seed)
    given = [(rng.choice("ab"), rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 5, 30]), 1) for _ in range(120)]
    df = table(spark, given)
    expected = brute_peak(given)
    assert {r.capture_id: r.peak for r in ops.peak_concurrency(df, ["capture_id"], chunk).collect()} == expected
    assert {r.capture_id: r.peak for r in ops.peak_concurrency(df.repartition(7, "entry_ix"), ["capture_id"], chunk).collect()} == expected


def test_peak_edges(spark):
    assert ops.peak_concurrency(table(spark, [("a", 0, 1, 1), ("a", 1, 1, 1)]), ["capture_id"]).first().peak == 1
    assert ops.peak_concurrency(table(spark, [("a", 0, 1, 1)] * 4), ["capture_id"]).first().peak == 4
    assert ops.peak_concurrency(table(spark, [("a", 0, 0, 1)]), ["capture_id"]).count() == 0
    assert ops.request_counts(table(spark, [("a", 0, 0, 1), ("a", 0, None, 1)]), ["capture_id"]).first()[1:] == (2, 1)


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_equal_linear_interpolation(spark, seed):
    rng = random.Random(seed)
    given = [("a" if rng.random() < 0.7 else None, 0, rng.choice([None, 0, 0.5, 3, rng.randrange(500)]), 1) for _ in range(101)]
    for row in ops.duration_stats(table(spark, given), ["capture_id"], (0, 0.5, 0.95, 1), 5).select("capture_id", "measured", *(micros(c).alias(c) for c in ("total", "longest", "p0", "p50", "p95", "p100"))).collect():
        own = np.array([x[2] for x in given if x[0] == row.capture_id and x[2] is not None]) * 1e6
        assert row.measured == len(own) and row.total == own.sum() and row.longest == own.max()
        for q, v in ((0, row.p0), (50, row.p50), (95, row.p95), (100, row.p100)):
            assert abs(np.percentile(own, q) - v) <= 1


def test_payload(spark):
    df = table(spark, [("a", 0, 1, 10), ("a", 0, 1, None), ("b", 0, 1, None)])
    assert sorted(ops.payload_bytes(df, ["capture_id"], "content_bytes").collect()) == [("a", 10, 10, 1), ("b", None, None, 0)]
    with pytest.raises(ValueError):
        ops.payload_bytes(df, ["capture_id"], "headers")


def test_detectors(spark):
    df = table(spark, [("a", 0, 10, 5), ("a", 5, 10, 5), ("a", 15, 1, 7), ("a", 3616, 1, 9), ("a", 7217, 1, 1)])
    one = lambda f: sorted((r.value_count, r.value_duration, [x.entry_ix for x in r.evidence]) for r in f(df).collect())
    assert one(d.waves) == [(3, None, [0, 3, 4])]  # a gap of 3601 s each; 15 -> 3616 exceeds the hour
    assert one(d.chains) == [(3, None, [0, 3, 4])]  # 15 touches the end before it
    assert one(d.idle) == [(None, timedelta(seconds=3600 + 3600), [])]
    assert one(d.errors) == [(2, None, [0, 1])]
    assert one(d.duplicates) == [(2, None, [0, 1])]
    assert one(d.heaviest) == [(5, None, [0]), (7, None, [2]), (9, None, [3])]
    assert one(d.slowest) == [(None, timedelta(seconds=10), [0, 1])]
    assert d.waves(table(spark, [("a", 0, 1, 1), ("a", 3600, 1, 1)])).first().value_count == 1  # exactly the limit
    assert d.detect(table(spark, [])).count() == 0


def test_evidence_is_bounded_and_its_rows_whole(spark):
    df = table(spark, [("a", 7200 * k, 1, 5) for k in range(12)] + [("b", 0, 1, 6)])
    for f in (d.waves, d.chains, d.errors, d.duplicates, d.slowest):
        found = {r.capture_id: r for r in f(df, most=4).collect()}["a"]
        assert [x.entry_ix for x in found.evidence] == [0, 1, 2, 3] and found.value_count in (12, None)
    rows = sorted((tuple(r) for r in d.evidence_rows(df).where("capture_id = 'a'").collect()), key=str)
    assert rows == sorted((("a", name, k, 0 if name == "duplicates" else None) for name in ("errors", "waves", "chains", "duplicates", "slowest") for k in range(12)), key=str)
    assert "WindowGroupLimit" in d.errors(df)._jdf.queryExecution().executedPlan().toString()  # cut down before the shuffle
    assert "WindowGroupLimit" in d.slowest(df)._jdf.queryExecution().executedPlan().toString()
    two = d.evidence_rows(table(spark, [("a", k, k // 4, k // 3) for k in range(9)])).where("detector in ('slowest', 'duplicates')")
    assert {tuple(r) for r in two.collect()} == {("a", "slowest", 8, None), *(("a", "duplicates", k, k // 3 * 3) for k in range(9))}
    # Null keys are groups as well.
    keyless = df.selectExpr("cast(null as string) capture_id", *df.columns[1:])
    assert [(r.value_count, len(r.evidence)) for r in d.errors(keyless).collect()] == [(12, 12)]


def record(run, **changes):
    made = {"run_id": run, "schema_version": 1, "analyzer_version": "1.0", "environment": "lab", "parse_status": "complete", "counts": [("m", 3), (f"only_{run}", 1)], "durations": [("d", timedelta(seconds=2))], "findings": []}
    return tuple((made | changes)[f.name] for f in RUN_RECORDS)


@pytest.mark.parametrize(
    ("changes", "mismatch", "count", "duration"),
    [
        ({}, "refuse", "ok", "ok"),
        ({"analyzer_version": "2.0"}, "refuse", "refused", "refused"),
        ({"analyzer_version": "2.0"}, "flag", "flagged", "flagged"),
        ({"schema_version": 2}, "flag", "refused", "refused"),
        ({"parse_status": "truncated"}, "refuse", "truncated", "truncated"),
        ({"environment": "field"}, "refuse", "ok", "environment"),
        ({"environment": "field", "analyzer_version": "2.0"}, "flag", "flagged", "environment"),
    ],
)
def test_gates(spark, changes, mismatch, count, duration):
    got = {r.metric: r for r in ops.compare(spark.createDataFrame([record("a"), record("b", **changes)], RUN_RECORDS), "a", "b", mismatch).collect()}
    assert got["m"].status == count and (got["m"].delta_count is not None) == (count in ("ok", "flagged"))
    assert got["d"].status == duration and (got["d"].delta_duration is not None) == (duration in ("ok", "flagged"))
    if "refused" not in (count, duration):
        assert got["only_a"].status == got["only_b"].status == "missing" and got["only_a"].delta_count is None


def test_a_run_id_that_occurs_twice(spark):
    status = lambda *rows: {(r.metric, r.status, r.base_count) for r in ops.compare(spark.createDataFrame(rows, RUN_RECORDS), "a", "b").collect() if r.metric == "m"}
    assert status(record("a"), record("a"), record("b")) == {("m", "ok", 3)}
    assert status(record("a"), record("a", counts=[("m", 4)]), record("b")) == {("m", "ambiguous", 4)}
    assert status(record("a"), record("b"), record("b", environment="field")) == {("m", "ambiguous", 3)}


def test_gate_needs_a_known_choice(spark):
    with pytest.raises(ValueError):
        ops.compare(spark.createDataFrame([], RUN_RECORDS), "a", "b", "ignore")


def test_stream_equals_table(spark, tmp_path):
    df = table(spark, [("a", k * 600, 1, k) for k in range(20)]).select("capture_id", "started", "content_bytes")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = windowed_counts(stream, ["capture_id"]).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("live").collect()) == sorted(windowed_counts(df, ["capture_id"]).collect())

import random
from datetime import datetime, timedelta

import pytest

from wirelens import operators as ops
from wirelens.operators import intervals

FIRST = datetime(2024, 3, 1)


def spans(seed, n, name):
    rng = random.Random(seed)
    at = lambda: FIRST + timedelta(seconds=rng.randrange(0, 20_000))
    rows = [(rng.choice(["a", "a", "b"]), k, at(), timedelta(seconds=rng.choice([0, 1, 60, 900, 4000, 9000]))) for k in range(n)]
    rows += [("a", n, None, timedelta(seconds=5)), ("a", n + 1, FIRST, None), (None, n + 2, FIRST, timedelta(days=1)), ("a", n + 3, FIRST + timedelta(hours=1), timedelta(hours=1)), ("a", n + 4, FIRST, timedelta(hours=1))]
    return rows, f"capture_id string, {name} int, started timestamp, duration interval day to second, bin string, part string"


@pytest.mark.parametrize("most", [4096, 3])
def test_overlaps_by_all_pairs(spark, monkeypatch, most):
    """Whole bins, and bins split into many parts, by broadcast and by shuffle."""
    monkeypatch.setattr(intervals, "MOST_IN_BIN", most)
    monkeypatch.setattr(intervals, "MOST_SPLIT", 1 << 17 if most > 3 else -1)
    (left, one), (right, two) = spans(1, 120, "entry_ix"), spans(2, 60, "page_ix")
    wide = lambda rows, schema: spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    live = lambda rows: [(k, i, s, s + d) for k, i, s, d in rows if k is not None and s is not None and d]
    want = sorted((k, i, j, min(z, y) - max(a, x)) for k, i, a, z in live(left) for q, j, x, y in live(right) if k == q and a < y and x < z)
    df = ops.overlaps(wide(left, one), wide(right, two), ["capture_id"], "entry_ix", "page_ix")
    assert sorted(map(tuple, df.collect())) == want and len(want) > 500
    assert "Cartesian" not in str(df._jdf.queryExecution().executedPlan()) and "NestedLoop" not in str(df._jdf.queryExecution().executedPlan())
    assert ops.overlaps(wide([], one), wide(right, two), ["capture_id"], "entry_ix", "page_ix").count() == 0


def test_overlaps_of_a_table_with_itself(spark):
    rows, schema = spans(3, 20, "entry_ix")
    df = spark.createDataFrame([(*r, "", "") for r in rows], schema)
    got = {(r.entry_ix, r.entry_ix_2) for r in ops.overlaps(df, df, ["capture_id"], "entry_ix", "entry_ix", bin_seconds=60).collect()}
    assert got == {(b, a) for a, b in got} and (20 + 3, 20 + 4) not in got  # one ends as the other begins


def test_baselines_by_definition(spark):
    rng = random.Random(4)
    rows = [(f"r{k:03d}", FIRST + timedelta(hours=rng.randrange(0, 90)) if k % 11 else None, 1, rng.choice(["1.0", "2.0"]), rng.choice(["lab", None]), rng.choice(["complete", "complete", "truncated"])) for k in range(150)]
    got = {r.run_id: r.baseline for r in ops.baselines(spark.createDataFrame(rows, "run_id string, started timestamp, schema_version int, analyzer_version string, environment string, parse_status string")).collect()}
    for run, at, *same, _ in rows:
        earlier = [(t, r) for r, t, *other, status in rows if other == same and status == "complete" and at and t and t < at]
        assert got[run] == (max(earlier)[1] if earlier else None), run
    assert len(got) == len(rows) and sum(b is not None for b in got.values()) > 80

import random
from datetime import datetime, timedelta
from unittest.mock import Mock

import pandas as pd
from hypothesis import given
from hypothesis import strategies as st

from wirelens.streaming.sessions import Sessions, merged, session_stream, sessions

FIRST = datetime(2024, 3, 1)
SCHEMA = "capture_id string, entry_ix int, started timestamp, content_bytes long"


def brute(rows, gap=1800):
    """(key, first, last, n, bytes) by walking each key's entries in order."""
    out = {}
    for key, _, t, size in sorted((r for r in rows if r[2] is not None), key=lambda r: (str(r[0]), r[2])):
        held = out.setdefault(key, [])
        if held and (t - held[-1][1]).total_seconds() < gap:
            s = held[-1]
            held[-1] = (s[0], t, s[2] + 1, s[3] if size is None else (s[3] or 0) + size)
        else:
            held.append((t, t, 1, size))
    return sorted(((k, *s) for k, held in out.items() for s in held), key=str)


def made(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), k, FIRST + timedelta(seconds=rng.randrange(0, 200_000)), rng.choice([None, 5, 70])) for k in range(n)]
    # A gap of exactly the length parts, one of a microsecond less doesn't; ties and rows without a start.
    rows += [("edge", 1, FIRST, 1), ("edge", 2, FIRST + timedelta(minutes=30), 1), ("edge", 3, FIRST + timedelta(minutes=60) - timedelta(microseconds=1), 1), ("edge", 4, FIRST, None), ("edge", 5, None, 9)]
    return rows


@given(st.lists(st.tuples(st.integers(0, 60), st.none() | st.integers(0, 9))), st.integers(0, 60))
def test_sessions_unite_in_any_order(points, k):
    one = [(t, t, 1, b) for t, b in points]
    assert merged(merged(one[:k], 5) + merged(one[k:], 5), 5) == merged(one, 5) == merged(one[::-1], 5)


def test_table(spark):
    rows = made()
    assert sorted(map(tuple, sessions(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert sessions(spark.createDataFrame([], SCHEMA)).collect() == []


def run(spark, folder, where, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = session_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/c").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def test_stream_with_late_rows_restarts_and_eviction(spark, tmp_path):
    """Batches in order of time, some rows late by less than allowed, in two runs from one checkpoint: each session leaves once, as the table has it; what is too late is left out, and state goes."""
    rows = [r for r in made(150, 5) if r[2] is not None]
    order = sorted(rows, key=lambda r: r[2] + timedelta(seconds=(r[1] % 9) * 60))  # up to eight minutes late
    folder = tmp_path / "in"
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    put(order[:50])
    run(spark, folder, tmp_path, "first")
    put(order[50:])
    end = ("end", 0, FIRST + timedelta(days=30), None)
    put([end])
    run(spark, folder, tmp_path, "second")
    too_late = [("a", 9, FIRST, 1), ("new", 1, FIRST, 1)]
    put([*too_late, ("end", 1, FIRST + timedelta(days=60), None)])
    put([("end", 2, FIRST + timedelta(days=90), None)])
    q = run(spark, folder, tmp_path, "third")
    got = spark.read.parquet(f"{tmp_path}/out").where("capture_id <> 'end' or capture_id is null")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert spark.read.parquet(f"{tmp_path}/out").where("capture_id = 'end'").count() == 2
    dropped = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])
    assert dropped == len(too_late)
    # The one session that is still open is all the state there is.
    store = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "open").load()
    assert store.count() == 1


class Handle:
    """Counts what a processor asks of its key's state and timers; stands for both."""

    def __init__(self):
        self.timers, self.calls, self.value = set(), 0, None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_key_has_one_timer_however_many_sessions():
    handle = Handle()
    one = Sessions(1000)
    one.init(handle)
    rows = pd.DataFrame({"us": [5000 * k for k in range(200)], "content_bytes": [None, 3.0] * 100})
    assert list(one.handleInputRows(("a",), iter([rows]), None)) == []
    assert handle.calls <= 3 and handle.timers == {1}
    # The watermark is in the middle of the sessions, behind the end of 100 of them: these leave at once.
    fired, now = Mock(), Mock()
    fired.getExpiryTimeInMs.return_value, now.getCurrentWatermarkInMs.return_value = handle.timers.pop(), 496
    left = pd.concat(one.handleExpiredTimer(("a",), now, fired))
    assert left["first"].tolist() == [5000 * k for k in range(100)] and left["bytes"].isna().sum() == 50
    assert handle.calls <= 6 and handle.timers == {501}
    now.getCurrentWatermarkInMs.return_value = 10**6
    fired.getExpiryTimeInMs.return_value = handle.timers.pop()
    assert len(pd.concat(one.handleExpiredTimer(("a",), now, fired))) == 100
    assert handle.value is None and not handle.timers

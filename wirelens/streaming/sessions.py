"""Sessions of requests: stretches without a gap, from a table by windows, from a stream by keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wirelens.functions.prefix import greatest_before, running_total

#: Where large state is kept: outside the heap, with changes written to the checkpoint.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What leaves of a session; instants are microseconds since 1970.
SESSION = "first long, last long, requests long, bytes long"
#: A key's open sessions, one value: Spark takes far longer over a list of rows than over arrays.
STATE = "first array<long>, last array<long>, requests array<long>, bytes array<long>"


def sessions(entries: DataFrame, key: str = "capture_id", gap: str = "30 minutes") -> DataFrame:
    """key, first, last, requests, bytes: an entry begins a session if no entry of its key started less than ``gap`` before it.

    For tables. Entries without a start belong to none. A hot key's entries
    are ordered by the hour, see ``prefix``.
    """
    rows = entries.where("started is not null").select(key, "started", "entry_ix", "content_bytes")
    hour = F.floor(F.unix_seconds("started") / 3600)
    rows = greatest_before(rows, [key], ["started", "entry_ix"], F.col("started"), hour, "before")
    begins = F.col("before").isNull() | (F.col("started") >= F.col("before") + F.expr(f"INTERVAL {gap}"))
    rows = rows.withColumn("_b", begins.cast("long")).withColumn("_o", F.struct("started", "entry_ix"))
    rows = running_total(rows, [key], "_o", "_b", hour, "session")
    found = rows.groupBy(key, "session").agg(F.min("started").alias("first"), F.max("started").alias("last"), F.count("*").alias("requests"), F.sum("content_bytes").alias("bytes"))
    return found.drop("session")


def merged(open_: list[tuple[int, int, int, int | None]], gap: int) -> list[tuple[int, int, int, int | None]]:
    """Sessions, of which those less than ``gap`` apart are one."""
    out: list[tuple[int, int, int, int | None]] = []
    for s in sorted(open_, key=lambda s: s[:2]):
        if out and s[0] - out[-1][1] < gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], s[3] if a[3] is None else a[3] if s[3] is None else a[3] + s[3])
        else:
            out.append(s)
    return out


class Sessions(StatefulProcessor):
    """Holds a key's open sessions; one leaves once the watermark has passed its last entry by the gap, so that no entry still to come can reach it.

    A key has one timer, that of its first session to be over; when it fires,
    all that are over leave together, so that a key's state is read and
    written once a batch, not once a session.
    """

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = min(map(self._due, held), default=None)
        for part in rows:
            # A batch becomes sessions first, so that what is held has a row a session, not a row an entry.
            made = [(int(t), int(t), 1, None if pd.isna(b) else int(b)) for t, b in zip(part["us"], part["content_bytes"], strict=True)]
            held = merged(held + merged(made, self.gap), self.gap)
        now = min(map(self._due, held))
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now)
        self._hold(held)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        over = [s for s in held if self._due(s) <= at]
        rest = [s for s in held if self._due(s) > at]
        if rest:
            self._hold(rest)
            self.handle.registerTimer(min(map(self._due, rest)))
        else:
            self.open.clear()
        if over:
            yield pd.DataFrame({"key": [key[0]] * len(over), **{n: [s[i] for s in over] for i, n in enumerate(("first", "last", "requests"))}, "bytes": pd.array([s[3] for s in over], dtype="Int64")})

    def _held(self) -> list[tuple[int, int, int, int | None]]:
        found = self.open.get()
        return list(zip(*found, strict=True)) if found else []

    def _hold(self, open_: list[tuple[int, int, int, int | None]]) -> None:
        self.open.update(tuple(map(list, zip(*open_, strict=True))))

    def _due(self, session: tuple) -> int:
        """The millisecond from which on a session is over."""
        return -(-(session[1] + self.gap) // 1000)

    def close(self) -> None:
        pass


def session_stream(entries: DataFrame, key: str = "capture_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``sessions`` of a stream of entries, each once, when it is over: key, first, last, requests, bytes.

    Entries may come ``late`` by so much, and then join, widen or unite open
    sessions; later ones are left out. State has a row a key with open sessions. The
    last sessions stay open until later entries, of any key, move the
    watermark on. Sets the session's state store to RocksDB, which this needs.
    """
    spark = entries.sparkSession
    spark.conf.set(*STORE)
    micros = int(spark.sql(f"SELECT INTERVAL {gap} div INTERVAL '0.000001' SECOND").first()[0])
    rows = entries.where("started is not null").withWatermark("started", late)
    rows = rows.select(F.col(key).cast("string").alias("key"), "started", F.unix_micros("started").alias("us"), F.col("content_bytes").cast("long").alias("content_bytes"))
    schema = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(SESSION).fields])
    found = rows.groupBy("key").transformWithStateInPandas(Sessions(micros), schema, "append", "eventTime")
    return found.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "requests", "bytes")

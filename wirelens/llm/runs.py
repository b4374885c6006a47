"""Periodic runs of words: a harmonic grid of longest common extensions, from suffix arrays and range minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.common import WORD, by_bytes

#: A run has so many words at least, and two periods.
LEAST = 12
#: Pairs of grid points that are looked at together, and words whose suffixes are sorted together (one text at least).
PAIRS, WORDS = 1 << 20, 1 << 17
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Extensions:
    """Longest common extensions to the right of two places: suffix array by prefix doubling, heights of neighbours, and minima over ranges of them.

    The last symbol must stand nowhere else. Takes some 200 bytes a word.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        ranks, step = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)], 1
        while ranks[-1].max() < n - 1:
            # Suffixes that reach the end differ before it, as the last symbol is alone.
            ahead = np.zeros(n, np.int64)
            ahead[:-step] = ranks[-1][step:] + 1
            ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1].astype(np.int32))
            step *= 2
        self.place = ranks[-1]
        order = np.argsort(self.place)
        high = np.zeros(n, np.int64)
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 2, -1, -1):
            same = np.flatnonzero((np.maximum(a, b) < n) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)]))
            a[same] += 1 << k
            b[same] += 1 << k
            high[1:][same] += 1 << k
        self.heights = high

    def lengths(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b, which differ: how many symbols from there on are the same. Ranges are answered by size, so that one row of minima is held at a time."""
        low, top = np.minimum(self.place[a], self.place[b]) + 1, np.maximum(self.place[a], self.place[b])
        level = np.frexp((top - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        minima = self.heights
        for k in range(int(level.max(initial=-1)) + 1):
            if k:
                half = 1 << k - 1
                minima = np.minimum(minima[:-half], minima[half:])
            of = np.flatnonzero(level == k)
            out[of] = np.minimum(minima[low[of]], minima[top[of] - (1 << k) + 1])
        return out


def grid(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) of grid points jp whose words and those of (j+1)p may lie in a run; ``symbols`` has four that stand nowhere else at either end.

    A run of period p, of LEAST words and two periods, holds a grid point and
    the next one, and matches itself p words on over LEAST/2 words about that
    point at least. So three words from the point on match or four before it;
    points where neither does can't be in a run and are never extended.
    """
    many = sizes // 2
    text = np.repeat(np.arange(len(sizes)), many)
    period = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + 1
    points = (sizes[text] - 1) // period
    ends = np.cumsum(points)
    a = 0
    while a < len(text):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS)))
        n, p, t = points[a:z], period[a:z], text[a:z]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(z - a), n)
        at = starts[t][of] + j * p[of]
        same = np.flatnonzero(symbols[at] == symbols[at + p[of]])
        at, of = at[same], of[same]
        match = lambda k: symbols[at + k] == symbols[at + p[of] + k]  # noqa: B023, E731
        may = match(1) & match(2) | match(-1) & match(-2) & match(-3) & match(-4)
        yield t[of[may]], p[of[may]], at[may]
        a = z


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts whose words, as numbers from 0, follow one another; by text, start and period."""
    n_texts, alone = len(sizes), -1 - np.arange(len(sizes) + 8)
    # A symbol that stands nowhere else follows every text; four stand before the first and behind the last.
    ends = np.cumsum(sizes)
    symbols = np.concatenate([alone[n_texts : n_texts + 4], np.insert(words, ends, alone[:n_texts]), alone[n_texts + 4 :]])
    starts = ends - sizes + np.arange(n_texts) + 4
    found = [x for x in grid(symbols, starts, np.where(sizes >= LEAST, sizes, 0)) if len(x[0])]
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, period, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(text, kind="stable")
    text, period, at = text[order], period[order], at[order]
    out, k = [], 0
    own = np.unique(text)
    weight = np.cumsum(sizes[own] + 1)
    while k < len(own):
        z = max(k + 1, int(np.searchsorted(weight, (weight[k - 1] if k else 0) + WORDS)))
        out.append(_extended(symbols, starts, sizes, own[k:z], *(x[np.searchsorted(text, own[k]) : np.searchsorted(text, own[z - 1], "right")] for x in (text, period, at))))
        k = z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _extended(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, text: np.ndarray, period: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of some texts from their grid points, extended both ways."""
    # The texts side by side again, each with the symbol behind it; the first also with one before it.
    joined = np.concatenate([[symbols.min() - 1], *(symbols[starts[t] : starts[t] + sizes[t] + 1] for t in own)])
    first = np.cumsum(sizes[own] + 1) - sizes[own]
    at = at - starts[text] + first[np.searchsorted(own, text)]
    ahead = Extensions(joined).lengths(at, at + period)
    last = len(joined) - 1
    behind = Extensions(joined[::-1]).lengths(last - (at - 1), last - (at + period - 1))
    start, length = at - behind, behind + period + ahead
    run = length >= np.maximum(LEAST, 2 * period)
    text, start, length, period = text[run], (start - first[np.searchsorted(own, text)])[run], length[run], period[run]
    # A run is also found by multiples of its period: the smallest counts.
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (x[new] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, length, period))


def _measured(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each of some texts."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parts = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(flat, "")  # white space at a text's ends leaves empty words
    of = np.repeat(np.arange(len(texts)), parts)[full.to_numpy(zero_copy_only=False)]
    words, sizes = flat.filter(full), np.bincount(of, minlength=len(texts))
    text, start, length, period = runs_of(words.dictionary_encode().indices.to_numpy().astype(np.int64), sizes)
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin[text] + start + period, 1)
    np.add.at(edge, begin[text] + start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
    offsets = lambda of: pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]), pa.int32())
    kept = pa.ListArray.from_arrays(offsets(of[keep]), words.filter(pa.array(keep)))
    return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets(text), runs), pc.binary_join(kept, " ")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length and period, by start and period), collapsed.

    A run is a stretch of consecutive words that repeats itself with a
    smallest period, has two periods and ``LEAST`` words, and can't be
    lengthened. ``collapsed`` is the text, joined by single spaces, without
    what follows the first period of any run. Null and empty texts have no
    words and no runs; texts of any length are taken whole, at some 200 bytes
    a word of the longest; repeated rows each give a row; an empty table gives
    an empty result; other columns are ignored. Nothing is shuffled.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in by_bytes(part, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([some.column(0), *_measured(some.column(1))], names=["id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    run = T.StructType([T.StructField(f.name, T.LongType()) for f in RUN])
    kind = plain.select("id").schema.add("n_words", "long").add("runs", T.ArrayType(run)).add("collapsed", "string")
    return plain.mapInArrow(rows, kind).withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, a tenth of which (by crc32 of the id as text; null: of the empty text) repeat a stretch of words up to their end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({WORD})"), F.lit(1)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), words.alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.coalesce(F.size("w"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of runs, the longest (ties: smallest start, then period; nulls without any), and hashes of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period")))), "\n")
    line = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("m"), F.sha2(line.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    period = -F.col("m.period")
    milli = F.floor(1000 * F.col("m.length") / period).cast("long")
    return rows.select(id_col, "n_runs", (-F.col("m.start")).alias("start"), F.col("m.length").alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Benchmark decontamination by winnowing: chosen fingerprints of documents are joined to those of benchmark items, and hits are extended to whole windows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.common import by_bytes, save

#: Consecutive words that count as contamination; items of fewer words are looked for whole.
WINDOW = 10
#: Words of a fingerprint. Of every WINDOW - GRAM + 1 neighbouring ones the smallest is kept, so each shared window holds a common one.
GRAM = 5
#: Bits of the filter of benchmark fingerprints that tasks get: 2 MB whatever the benchmark's size. It only spares work; the join decides.
FILTER_BITS = 24
#: So many different windows of the benchmark are broadcast at most; beyond that they are joined by a shuffle.
MOST_WINDOWS = 1 << 17
#: Every byte of ASCII but digits and letters parts words.
PARTING = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
#: Multiplier of the hash over words: an odd constant, fixed so that all tasks agree.
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased runs of digits, letters and everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(PARTING).split()


def hashes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; each different word is hashed once."""
    coded = pa.array(found, pa.binary()).dictionary_encode()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()] if found else own


def minima(h: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of every window of so many words, by its first word: the smallest hash of its runs of GRAM words, or of all its words if those are fewer."""
    gram = min(GRAM, window)
    if len(h) < window:
        return np.empty(0, np.uint64)
    n = len(h) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g * BASE + h[j : j + n]
    g ^= g >> np.uint64(29)
    g *= BASE
    g ^= g >> np.uint64(32)
    out = g[: len(h) - window + 1].copy()
    for j in range(1, window - gram + 1):
        np.minimum(out, g[j : j + len(out)], out=out)
    return out


def passing(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each fingerprint, named by its first bits, is set in the filter."""
    place = g >> np.uint64(65 - (len(bits) * 64).bit_length())
    return bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def _windows(found: list[bytes], sizes: Iterable[int], passes: np.ndarray | None) -> dict[str, list]:
    """Windows of the words, of each size: size, g, start and text; with a filter, only those whose fingerprint passes it."""
    out: dict[str, list] = {"size": [], "g": [], "start": [], "text": []}
    h = hashes(found)
    for size in sizes:
        g = minima(h, size)
        at = np.arange(len(g)) if passes is None else np.flatnonzero(passing(g, passes))
        out["size"] += [size] * len(at)
        out["g"] += g[at].astype(np.int64).tolist()
        out["start"] += at.tolist()
        out["text"] += [b" ".join(found[i : i + size]).decode("utf-8", "surrogatepass") for i in at.tolist()]
    return out


KIND = pa.struct([("size", pa.int32()), ("g", pa.int64()), ("start", pa.int32()), ("text", pa.string())])
NAMES = T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("g", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))


def _scan(df: DataFrame, id_col: str, text_col: str, sizes: list[int] | None, passes: np.ndarray | None) -> DataFrame:
    """Per row: row (a number), id, n_words, windows. Without sizes a text's windows are those of WINDOW words, or the whole text if it has fewer."""
    held = df.sparkSession.sparkContext.broadcast(passes) if passes is not None else None

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for some in by_bytes(part, "text", 1 << 20):
                counts, ends, made = [], [0], {"size": [], "g": [], "start": [], "text": []}
                for text in some.column(1):
                    found = words(text.as_py())
                    for k, v in _windows(found, sizes if sizes is not None else [min(WINDOW, len(found))] if found else [], held and held.value).items():
                        made[k] += v
                    counts.append(len(found))
                    ends.append(len(made["g"]))
                values = pa.StructArray.from_arrays([pa.array(made[f.name], f.type) for f in KIND], fields=list(KIND))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["id", "n_words", "windows"])

    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.select(F.col(id_col).alias("id")).schema.add("n_words", "long").add("windows", NAMES)
    return plain.mapInArrow(rows, kind).withColumn("row", F.monotonically_increasing_id())


def _filter(prints: DataFrame) -> np.ndarray:
    """The filter of a column of fingerprints: a bit for each of the first bits of a hash. Tasks gather 64 bits to a row, so the driver gets 2^18 rows at most."""
    place = F.shiftrightunsigned("g", 64 - FILTER_BITS)
    bits = prints.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(g, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (ids whose windows occur, as sorted strings), spans (array of start and end of hit words, end exclusive).

    A window is ``WINDOW`` consecutive words of an item, or all words of an
    item that has fewer. A document's word is hit if it stands in an
    occurrence of a window. Null and empty texts have no words and no windows;
    repeated rows each give a row; an empty table on either side gives rows
    without hits, or none; other columns are ignored; items without an id
    count under the empty string.

    Windows of documents whose fingerprint the benchmark has are joined on
    fingerprint and words to the benchmark's different windows, which a window
    matches one of at most: a passage that many documents or items share gives
    a row for each place, never pairs of places. Texts don't move.
    """
    ours = save(_scan(benchmark, item_col, item_text_col, None, None).select("id", F.inline("windows")).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), "size", "g", "text").distinct())
    known = save(ours.select("size", "g", "text").distinct())
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # ten at most
    scanned = save(_scan(docs, id_col, text_col, sizes, _filter(known)))

    side = F.broadcast(known) if known.count() <= MOST_WINDOWS else known
    places = scanned.where(F.size("windows") > 0).select("row", F.inline("windows"))
    hits = save(places.join(side, ["size", "g", "text"]))

    # Words hit: each window adds what lies beyond the furthest end so far.
    doc = W.partitionBy("row").orderBy("start", "size")
    far = F.max(F.col("start") + F.col("size")).over(doc.rowsBetween(W.unboundedPreceding, -1))
    ends = hits.select("row", "start", "size").withColumn("far", F.coalesce(far, F.lit(-1)))
    runs = ends.withColumn("run", F.sum((F.col("start") > F.col("far")).cast("int")).over(doc.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "run").agg(F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("size")).cast("long").alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    texts = hits.select("row", "size", "g", "text").distinct()
    owned = F.broadcast(ours) if ours.count() <= MOST_WINDOWS else ours
    items = texts.join(owned, ["size", "g", "text"]).select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(items, "row")
    whole = scanned.select("row", F.col("id").alias(id_col), "n_words").join(found, "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return whole.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, and a hash of the items' ids."""
    joined: Column = F.array_join("items", ",")
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

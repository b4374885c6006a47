"""Best-fit packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.common import batches, fresh, save

CAPACITY = 2048
#: Pieces that are packed together; a group leaves about one sequence part-filled.
GROUP = 4096
#: Characters for which both tokenizer libraries split words alike; any other text takes the reference library.
_PLAIN = re.compile("[^\n -~¡-ɏ]")


@cache
def encoders(json_path: str, ranks_path: str | None):
    """The tokenizer as its file has it; one that takes special tokens' names for ordinary text; a faster one that does so too; a pattern of the names."""
    from tokenizers import Tokenizer

    stated, ordinary = Tokenizer.from_file(json_path), Tokenizer.from_file(json_path)
    ordinary.encode_special_tokens = True
    names = [re.escape(t.content) for t in stated.get_added_tokens_decoder().values()]
    special = re.compile("|".join(names) or r"(?!)")
    if ranks_path is None:
        return stated, ordinary, None, special
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return stated, ordinary, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def encode(text: str | None, json_path: str, ranks_path: str | None = None, special: bool = True) -> np.ndarray:
    """Token ids of a text as little-endian unsigned 32-bit numbers, none added; ``ranks_path`` holds the same vocabulary for the faster library.

    With ``special``, a special token's name in the text is that token, as the
    tokenizer's own call has it; without it, the name is ordinary text.
    """
    stated, ordinary, fast, names = encoders(json_path, ranks_path)
    text = text or ""
    if special and names.search(text):
        return np.array(stated.encode(text, add_special_tokens=False).ids, "<u4")
    if fast is not None and not _PLAIN.search(text):
        return np.array(fast.encode_ordinary(text), "<u4")
    return np.array(ordinary.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def _packed(json_path: str) -> str:
    """The type that ids are stored in before they are packed."""
    if encoders(json_path, None)[0].get_vocab_size() > 1 << 16:
        raise ValueError("ids are kept with vocabularies of 65,536 tokens at most")
    return "<u2"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, of which the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts, end each with id 0 and cut those longer than ``capacity``.

    Per piece: id, piece, start, length, ids_crc32 and, if asked for, ids: a
    binary of little-endian unsigned 16-bit numbers. A null text counts as
    empty and gives one piece that holds the end alone. Repeated rows each
    give their pieces; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.append(encode(text.as_py(), json_path, ranks_path), np.uint32(0)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    yield (i, k, start, length, zlib.crc32(own.tobytes()), *([own.astype(_packed(json_path)).tobytes()] if with_ids else []))

    names = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda it: batches(rows(it), schema, weight=5 if with_ids else None), names)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", id_col)


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every item.

    Items above a third of the capacity go at most two to a bin: the largest
    is paired with the largest other that still fits beside it. The smaller
    ones, largest first, go where they leave the least room.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    waiting: dict[int, list[int]] = {}
    large = [i for i in order.tolist() if 3 * sizes[i] > capacity]
    for i in large:
        waiting.setdefault(int(sizes[i]), []).append(i)
    present = sorted(waiting)
    rooms: list[tuple[int, int]] = []
    count = 0

    def take(k: int) -> int:
        item = waiting[present[k]].pop()
        if not waiting[present[k]]:
            present.pop(k)
        return item

    while present:
        first = take(len(present) - 1)
        bins[first], filled = count, int(sizes[first])
        k = bisect_left(present, capacity - filled + 1) - 1
        if k >= 0:
            second = take(k)
            bins[second], offsets[second] = count, filled
            filled += int(sizes[second])
        if filled < capacity:
            rooms.append((capacity - filled, count))
        count += 1
    rooms.sort()
    for i in order[len(large) :].tolist():
        size = int(sizes[i])
        k = bisect_left(rooms, (size, -1))
        room, own = rooms.pop(k) if k < len(rooms) else (capacity, count)
        count += own == count
        bins[i], offsets[i] = own, capacity - room
        if room > size:
            insort(rooms, (room - size, own))
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to ``pieces``; each sequence is filled without gaps from 0.

    Pieces are dealt by hash into groups of about ``group`` rows, whatever the
    size of the table, and each group is packed alone, by its lengths; ids, if
    there are any, stay with the JVM and are joined back. Repeated rows are
    placed each on its own; an empty table stays empty.
    """
    (row,) = fresh(pieces, "_row")
    pieces = save(pieces.withColumn(row, F.monotonically_increasing_id()))  # fixed by being saved
    groups = max(1, round(pieces.count() / group))
    narrow = pieces.drop("ids")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_h", "piece"], kind="stable").reset_index(drop=True)
        bins, offsets = place(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"], pdf["offset"] = bins + pdf["_g"].astype("int64") * (1 << 32), offsets
        return pdf.drop(columns=["_g", "_h"])

    hashed = narrow.withColumn("_h", F.xxhash64(id_col, "piece", "ids_crc32", row)).withColumn("_g", F.pmod("_h", F.lit(groups)))
    schema = T.StructType([*narrow.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = hashed.groupBy("_g").applyInPandas(fill, schema)
    if "ids" not in pieces.columns:
        return placed.drop(row)
    return pieces.join(placed.select(row, "sequence_id", "offset"), row).drop(row)

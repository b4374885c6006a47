"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import attach, fold_ascii, row_key, save, staying

PREFIX_CHARS = 128
#: Up to so many groups of equal length and prefix, their keys (8 bytes each) are broadcast to the scan that hashes whole texts.
MOST_KEYS = 1 << 19


def _prefix(text: Column) -> tuple[Column, Column]:
    """Length in bytes, and a hash of length and first characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.octet_length(text)
    return size, F.xxhash64(size, fold_ascii(F.substring(text, 1, PREFIX_CHARS)))


def _digest(text: Column) -> Column:
    return F.sha2(fold_ascii(text.cast("string")).cast("binary"), 256)


def _surviving(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """Keys of length and prefix that more than one row has (prefix, n), and the number of rows.

    Lengths are counted first; only rows whose length repeats are counted by
    prefix. Both counts combine before the shuffle, so a hot key moves a row a
    task. Keys are hashes; two groups that share one only cost a hash of texts.
    """
    size, prefix = _prefix(F.col(text_col))
    narrow = save(docs.select(size.alias("size"), prefix.alias("prefix")))
    sizes = save(narrow.groupBy("size").agg(F.count("*").alias("n")))
    total = int(sizes.agg(F.sum("n")).first()[0] or 0)
    again = attach(narrow, sizes.where("n > 1"), ["size"], total).where("n > 1")
    return save(again.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1")), total


def _hashed(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> tuple[DataFrame, int]:
    """Saved rows (id, key, alive, sha), and their number: whether a row's length and prefix repeat, and the hash of its whole text, or of every text with ``digest``.

    Texts are hashed where they are read and never move. While the repeated
    keys are few enough to broadcast, only texts that repeat them are hashed;
    beyond that all are, and the narrow rows are joined to the keys, with the
    same result.
    """
    keys, total = _surviving(docs, text_col)
    text = F.col(text_col).cast("string")
    names = [F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), _prefix(text)[1].alias("prefix")]
    alive = F.col("n").isNotNull()
    if keys.count() <= MOST_KEYS:
        marked = docs.select(*names, F.col(text_col).alias("t")).join(F.broadcast(keys), "prefix", "left")
        sha = _digest(F.col("t"))
        rows = marked.select("id", "key", alive.alias("alive"), (sha if digest else F.when(alive, sha)).alias("sha"))
    else:
        marked = attach(save(docs.select(*names, _digest(text).alias("sha"))), keys, ["prefix"], total)
        rows = marked.select("id", "key", alive.alias("alive"), (F.col("sha") if digest else F.when(alive, F.col("sha"))).alias("sha"))
    return save(rows), total


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest id stays; a null id is
    smaller than any other. Rows whose length is unique are settled without
    hashing; rows whose length and prefix are unique without a hash of the
    whole text (``text_sha256`` is then null unless ``digest`` asks for it
    everywhere). Rows that repeat both id and text count each in
    ``group_size``, and each has ``kept`` set if its id is the largest;
    ``exact_dedup`` keeps one of them. An empty table gives an empty result;
    other columns are ignored.
    """
    hashed, total = _hashed(docs, id_col, text_col, digest)
    alive, lone = hashed.where("alive"), hashed.where("not alive")
    groups = save(alive.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("n")))
    joined = attach(alive, groups, ["sha"], total).select("id", "keep_id", F.col("n").alias("group_size"), "sha")
    whole = joined.unionByName(lone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return whole.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row for each text, with the largest id.

    Equality and ids are those of ``exact_groups``. Rows, not ids, are judged:
    an id that stands on several texts stays with each text of which it is the
    largest, and a row without an id stays if no equal text has one. Of rows
    alike in id and text one stays. What is judged are narrow rows; the texts
    are read once more, without the rows that go.
    """
    hashed, total = _hashed(docs, id_col, text_col, False)
    alive = hashed.where("alive")
    # A null id is smaller than any other; of equal ids the key decides.
    best = save(alive.groupBy("sha").agg(F.max(F.struct("id", "key")).alias("best"), F.count("*").alias("n")))
    judged = attach(alive, best.where("n > 1"), ["sha"], total).where("n > 1")
    verdicts = judged.groupBy("key").agg(F.first(F.col("key") == F.col("best.key")).alias("stays"), F.count("*").alias("n"))
    return staying(docs, save(verdicts), id_col, text_col)

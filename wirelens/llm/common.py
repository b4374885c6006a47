"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Up to so many row keys (8 bytes each) are broadcast.
MOST_KEYS = 1 << 19
#: Bytes of an Arrow batch that goes from a task's JVM to its Python.
BATCH_BYTES = 4 << 20
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches that this session sends to Python are bounded by bytes.

    Spark bounds them by rows alone, 10,000 of them, however long their texts;
    buffers outside the heap double up to that and stay with the executor, and
    Python holds a batch beside what it makes of it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage by a written table in the shared folder.

    Loops need this: a checkpoint keeps Spark's estimate of its size, and
    estimates of joins are products, so that in tables joined round after
    round they double their digits each time, until planning takes all the
    time. A file's size is known.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, UPPER.lower())


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased: bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of words of every text, and all words in order, A-Z lower-cased; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    found, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    full = pc.not_equal(found, "")  # white space at a text's ends leaves empty words
    of = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    return np.bincount(of, minlength=len(texts)), found.filter(full)


def by_bytes(part: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a text column, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(part.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    a = 0
    while a < part.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most)))
        yield part.slice(a, z - a)
        a = z


def least_count(counts: DataFrame, most: int, n: str = "n") -> int:
    """The least count from which on there are ``most`` rows or fewer; the driver sees a histogram of some hundred bars at most."""
    bar = F.floor(F.log2(n) * 8)
    held, least = 0, 1 << 62
    for r in counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("rows"), F.min(n).alias("least")).orderBy(F.desc("bar")).collect():
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return least


def remainder(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def remainder_col(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def row_key(id_: Column, text: Column) -> Column:
    """A hash of a row's id and text, either of which may be null."""
    return F.xxhash64(id_.cast("string"), id_.isNull(), text.cast("string"), text.isNull())


def staying(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. ``verdicts``, a saved table, has a row for each row key judged: key, stays, n (rows of that key); of rows alike in id and text one stays.

    Only keys of rows that go or that are repeated are joined, and broadcast
    if they are few enough; rows that nothing is said of stay where they are.
    """
    key, row = fresh(docs, "_key", "_row")
    named = docs.withColumn(key, row_key(F.col(id_col), F.col(text_col)))
    gone = verdicts.where("not stays").select(F.col("key").alias(key))
    left = named.join(F.broadcast(gone) if gone.count() <= MOST_KEYS else gone, key, "left_anti")
    again = verdicts.where("stays and n > 1").select(F.col("key").alias(key))
    if again.isEmpty():
        return left.select(docs.columns)
    # Rows that are repeated whole: each task sends one of them.
    again = F.broadcast(again) if again.count() <= MOST_KEYS else again
    one = left.join(again, key, "left_semi").groupBy(key).agg(F.any_value(F.struct(*docs.columns)).alias(row))
    return left.join(again, key, "left_anti").select(docs.columns).unionByName(one.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def batches(rows: Iterable[tuple], schema: pa.Schema, weight: int | None = None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size; ``weight`` is the position of the column that holds the bulk."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[weight]) if weight is not None and row[weight] is not None else 0)
        if size >= most:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str = "n") -> DataFrame:
    """Left-join ``groups`` (one row a key, with the key's row count in ``size``) to ``rows``.

    A key may hold a third of all rows. Keys with at least a thousandth of
    ``total`` rows number a thousand at most, so those are broadcast and
    their rows do not move; the others are joined by a shuffle. Both inputs
    are read twice and so should be saved tables.
    """
    cut = max(200, total // 1000)
    names = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) >= cut)
    marked = rows.join(F.broadcast(hot), keys, "left")
    near = marked.where(F.col(size).isNotNull())
    far = marked.where(F.col(size).isNull()).drop(*names).join(groups.where(F.col(size) < cut), keys, "left")
    return near.unionByName(far)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of integer nodes: (node, component), the component being its smallest node.

    Alternates large-star and small-star steps on saved edge tables until the
    edges no longer change; every step keeps one edge a node at most, in
    expectation halving the depth. No node's neighbours are ever collected.
    """
    e = save(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = save(e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        e = _star(both, F.col("v") > F.col("u"))
        e = _star(save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()), F.lit(True))
        e = store(e.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return store(found.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def _star(e: DataFrame, moved: Column) -> DataFrame:
    """Link every neighbour v of u (for which ``moved`` holds), and u, to the smallest of u and its neighbours."""
    low = save(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")))
    known = attach(e, low, ["u"], e.count())
    return known.where(moved).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))

"""Merkle manifest: a hash tree over the rows of each group, reduced superblock by superblock, with a proof for every row."""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.llm.common import remainder_col, save

#: Consecutive nodes that become one.
FANOUT = 2
#: Levels that one task collapses at a time: a superblock has FANOUT ** LEVELS nodes at most.
LEVELS = 11
#: So many rows of a table of partitions' totals are broadcast at most; beyond that it is joined by a shuffle.
MOST_PARTS = 1 << 17
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, ix long, n long, digest string"


def field(value: Column) -> Column:
    """A value as its size in UTF-8 bytes, a colon and itself; ``-`` if null. Different rows of fields never look alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(start: Column, before: Column, after: Column) -> Column:
    """The root that a leaf comes to with the siblings of each level, those before it and those after it."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), start, lambda held, s: F.sha2(F.concat(s["before"], held, s["after"]).cast("binary"), 256))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``ix``, their place in their ``tree`` from 0 in the order given, and ``n``, the tree's rows.

    Rows are dealt by ranges of tree and order, so that a tree with most of
    the rows is spread; what a partition holds of a tree is counted, and the
    counts, a row a partition and tree, are summed along the tree. The order
    must be total, or rows alike in it must be spread by a last column.
    """
    ranged = rows.repartitionByRange(F.col("tree"), *order).sortWithinPartitions(F.col("tree"), *order)
    # The number of a row holds its partition and its place there; it is written with the row.
    dealt = save(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    whole = W.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = save(parts.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")).alias("_base"), F.sum("_rows").over(whole).alias("n")))
    side = F.broadcast(parts) if parts.count() <= MOST_PARTS else parts
    return dealt.join(side, ["tree", "_part"]).select(*rows.columns, (F.col("_at") + F.col("_base")).alias("ix"), "n")


def height(n: int, fanout: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def grow(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of a superblock, level by level, the given ones first."""
    out = [digests]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[i : i + fanout]).encode()).hexdigest() for i in range(0, len(low), fanout)])
    return out


def reduced(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of the superblocks of ``nodes`` (tree, ix, n, digest), as nodes again; ``ix`` is a superblock's number."""
    size = fanout**levels

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        top = grow(rows.sort_values("ix")["digest"].tolist(), min(levels, height(n, fanout)), fanout)[-1]
        return pd.DataFrame({"tree": [key[0]], "ix": [key[1]], "n": [-(-n // size)], "digest": top})

    dealt = nodes.select("tree", "ix", "n", "digest", F.floor(F.col("ix") / size).alias("block"))
    return dealt.groupBy("tree", "block").applyInPandas(up, NODE)


def proven(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with the siblings up to the root: those within the superblock, then those of the superblock's root (``upper``: tree, ix, before, after, root, subroot)."""
    size = fanout**levels
    schema = nodes.drop("block").schema
    for name in ("before", "after", "root", "subroot"):
        schema = schema.add(name, upper.schema[name].dataType)

    def down(key: tuple, own: pa.Table, above: pa.Table) -> pa.Table:
        own = own.sort_by("ix")
        n = own.column("n")[0].as_py()
        tree = grow(own.column("digest").to_pylist(), min(levels, height(n, fanout)), fanout)[:-1]
        high = above.to_pylist()[0]
        before, after = [], []
        for i in range(own.num_rows):
            left, right = [], []
            for low in tree:
                run = i - i % fanout
                left.append("".join(low[run:i]))
                right.append("".join(low[i + 1 : run + fanout]))
                i //= fanout
            before.append(left + high["before"])
            after.append(right + high["after"])
        own = own.drop_columns(["block"])
        texts = pa.list_(pa.string())
        own = own.append_column("before", pa.array(before, texts)).append_column("after", pa.array(after, texts))
        return own.append_column("root", pa.array([high["root"]] * len(before))).append_column("subroot", pa.array([high["subroot"]] * len(before)))

    dealt = nodes.withColumn("block", F.floor(F.col("ix") / size)).groupBy("tree", "block")
    return dealt.cogroup(upper.withColumnRenamed("ix", "block").groupBy("tree", "block")).applyInArrow(down, schema)


def tiers(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes given, the roots of their superblocks, the roots of those, and so on until every tree has one node; a tier has a share of FANOUT ** LEVELS of the one below."""
    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        out.append(save(reduced(out[-1], fanout, levels)))
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, tree (the group as a field), ix, n, leaf, subroot, root, before and after (siblings of each level), and what ``carry`` names.

    A leaf hashes the row's ``fields``. The leaves of a group ascend by id
    (null first; rows of one id by their leaf), every ``fanout`` consecutive
    nodes become one until one is left, and the groups' roots, null first and
    by bytes, likewise give the root. Null, empty and very long values are
    fields like others; rows repeated whole are leaves each; an empty table
    gives an empty result; columns that aren't named are ignored. No group is
    ever in one task: tasks hold a superblock, and tiers of superblocks shrink
    until one is left. Texts are hashed where they are read and never move.
    """
    carry = carry or {}
    rows = docs.select(field(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), leaf(*(F.col(c) for c in fields)).alias("digest"), *(c.alias(f"c_{k}") for k, c in carry.items()))
    # Rows alike in all fields are spread by their number.
    rows = save(rows.withColumn("uid", F.monotonically_increasing_id()))
    leaves = placed(rows, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("uid")]).drop("uid")
    leaves = save(leaves)
    up = tiers(leaves, fanout, levels)

    group = F.when(F.col("tree") != "-", F.expr("substring(tree, instr(tree, ':') + 1)"))
    roots = save(up[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), group.alias("group"), "digest"))
    top = tiers(save(placed(roots, [F.col("group").asc_nulls_first()])), fanout, levels)
    none = F.array().cast("array<string>")
    path = top[-1].select("tree", "ix", none.alias("before"), none.alias("after"), F.col("digest").alias("root"), F.lit("").alias("subroot"))
    for nodes in reversed(top[:-1]):
        found = proven(nodes, path, fanout, levels)
        path = found.select("tree", "ix", "before", "after", "root", "subroot")
    path = save(found.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("ix"), "before", "after", "root", F.col("digest").alias("subroot")))
    for nodes in reversed(up[:-1]):
        found = proven(nodes, path, fanout, levels)
        path = found.select("tree", "ix", "before", "after", "root", "subroot")
    return found.select(F.col("id").alias(id_col), "tree", "ix", "n", F.col("digest").alias("leaf"), "subroot", "root", "before", "after", *(F.col(f"c_{k}").alias(k) for k in carry))


def tamper_check(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest of documents, each folded from its own proof: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose crc32 of the id (null: of the empty text) ``every``
    divides are folded from a leaf with 1 added to ``n_chars``; a null
    ``n_chars`` stays, so such a document is verified all the same. Other odd
    rows are as in ``manifest``.
    """
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when((remainder_col(F.col("doc_id"), every) == 0) & F.col("n_chars").isNotNull(), leaf(*changed))
    rows = manifest(docs, carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("before"), F.col("after")))
    siblings = F.concat(F.lit(""), F.array_join(F.zip_with("before", "after", lambda a, b: F.concat(a, b)), ""))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Near-duplicate groups by SimHash fingerprints, compared exactly tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import MOST_KEYS, attach, batches, components, row_key, save, staying, store, words

RADIUS = 4
#: Of the wide fingerprint of 128 bits: at a similarity of 0.8 some 20 differing bits are expected, with a deviation of 4, half of them in the first half. Three deviations are added, so that hardly a pair of 0.8 is missed; the check decides.
WIDE_RADIUS, FIRST_RADIUS = 32, 20
#: Links that a node proposes in each strip of a comparison after the forest was checked, and times as many in each further round.
FIRST_PROPOSALS, MORE_PROPOSALS = 1, 4
#: Pairs whose sets of shingles go to Python at a time; a usual set has some kilobytes.
PAIRS_AT_ONCE = 256
#: Buckets that a set's hashes are counted in, up to 15 each, for a bound on its likeness to others; pairs that are bounded at once.
BUCKETS, BOUNDED = 128, 1 << 16
SKETCH = [f"k{i}" for i in range(BUCKETS // 16)]
#: Tiles hold a 32nd of the fingerprints each, within these bounds; so the pairs of tiles, and the copies sent of each, stay as many.
TILES, LEAST, MOST = 32, 512, 1 << 18
#: Pairs that a strip of a comparison holds at once.
STRIP = 1 << 21


def fingerprint(text: str | None, shingle: int = 5, wide: bool = False) -> int:
    """SimHash of a text's word shingles, repeats included: a bit is 1 if set in over half of the hashes. No words: 0. 64 bits, or 128."""
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    k = min(shingle, len(w))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(w) - k] + 1).tolist()]
    n, size = len(stops), 16 if wide else 8
    digest = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest  # most significant byte first
    ones = np.zeros(8 * size, np.int64)
    for a in range(0, n, 1 << 16):
        h = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[a : a + (1 << 16)], stops[a : a + (1 << 16)], strict=True)])
        ones += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, size), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """id, key (of id and text), and fingerprint of every row: ``fp``, the first 64 bits as a signed number, and ``fp2``, the others or 0; a null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for i, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                fp = fingerprint(text.as_py(), shingle, wide)
                yield (i, key, _signed(fp >> 64), _signed(fp & (1 << 64) - 1)) if wide else (i, key, _signed(fp), 0)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long"), row_key(F.col(id_col), text), text).mapInArrow(lambda it: batches(rows(it), schema), "doc_id long, key long, fp long, fp2 long")


def links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, step: int | None = None, a2: np.ndarray | None = None, b2: np.ndarray | None = None, whole: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between tiles a and b, or within a: indices into a, and into b (or a).

    Links are pairs at ``radius`` or fewer differing bits; with second halves
    a2 and b2, those of them at ``whole`` or fewer in both halves, the nearest
    of both halves first. Each strip
    of the comparison is reduced to edges that join parts not joined before,
    so a group of many near copies gives one edge a member.
    """
    own = b is None
    b, b2 = (a, a2) if own else (b, b2)
    step = step or max(1, STRIP // max(1, len(b)))
    shift = 0 if own else len(a)
    label = np.arange(len(a) + (0 if own else len(b)))
    left, right = [], []
    for s in range(0, len(a), step):
        strip = a[s : s + step]
        first = s + 1 if own else 0
        if first >= len(b):
            break
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ b[None, first:]) <= radius)
        i, j = i + s, j + first
        if a2 is not None:
            near = np.bitwise_count(a[i] ^ b[j]).astype(np.int64) + np.bitwise_count(a2[i] ^ b2[j]) <= whole
            i, j = i[near], j[near]
        if own:
            i, j = i[j > i], j[j > i]
        while len(i):
            p, q = label[i], label[j + shift]
            apart = p != q
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            if not len(i):
                break
            # Each part hangs itself on the part before it that is nearest in bits; one edge stands for that.
            high, low = np.maximum(p, q), np.minimum(p, q)
            bits = np.bitwise_count(a[i] ^ b[j]) if a2 is None else np.bitwise_count(a[i] ^ b[j]) + np.bitwise_count(a2[i] ^ b2[j])
            order = np.lexsort((low, bits, high))
            keep = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            left.append(i[keep])
            right.append(j[keep])
            to = np.arange(len(label))
            to[high[keep]] = low[keep]
            while (to[to] != to).any():
                to = to[to]
            label = to[label]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A set's hashes counted by buckets, up to 15, as eight numbers of 64 bits."""
    counts = np.minimum(np.bincount((hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).view(np.int64)


def may_be_alike(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets may be alike to ``similarity``, by their sizes and sketches (a[i] and b[j]: a size, then the sketch); none that are is ruled out.

    Sets alike to s share s / (1 + s) of the sum of their sizes or more, so
    that (1 - s) / (1 + s) of it at most is in one of them alone. Counts by
    buckets, cut off or not, differ by no more in all than what is in one
    alone.
    """
    nibbles = lambda t: (lambda x: np.concatenate([x & 15, x >> 4], 1).astype(np.int8))(np.ascontiguousarray(np.stack(t[1:], 1)).view(np.uint8))
    x, y, out = nibbles(a), nibbles(b), np.zeros(len(i), bool)
    for s in range(0, len(i), BOUNDED):
        p, q = i[s : s + BOUNDED], j[s : s + BOUNDED]
        n, m = a[0][p].astype(np.int64), b[0][q].astype(np.int64)
        alone = np.maximum(np.abs(x[p] - y[q]).sum(1, dtype=np.int64), np.abs(n - m))
        out[s : s + BOUNDED] = alone <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6
    return out


def proposals(a: list[np.ndarray], b: list[np.ndarray] | None, radius: int, whole: int, most: int, similarity: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between tiles a and b, or within a, whose ends are in different components: the node that proposes, the other, and whether the first has more.

    A tile is fp, fp2, node, component and the component's size; with
    ``similarity`` also the size and the sketch of the text's set of shingles,
    and pairs that these rule out are no links. Of two
    components the smaller one's node proposes, so that a large one's many
    nodes do not; each proposes its ``most`` nearest links in a strip.
    """
    own = b is None
    b = a if own else b
    out = []
    for s in range(0, len(a[0]), max(1, STRIP // max(1, len(b[0])))):
        strip = a[0][s : s + max(1, STRIP // max(1, len(b[0])))]
        first = s + 1 if own else 0
        i, j = np.nonzero(np.bitwise_count(strip[:, None] ^ b[0][None, first:]) <= radius)
        i, j = i + s, j + first
        bits = np.bitwise_count(a[0][i] ^ b[0][j]).astype(np.int64) + np.bitwise_count(a[1][i] ^ b[1][j])
        fit = (bits <= whole) & (a[3][i] != b[3][j]) & ((j > i) | (not own))
        i, j, bits = i[fit], j[fit], bits[fit]
        if similarity is not None:
            fit = may_be_alike(a[5:], i, b[5:], j, similarity)
            i, j, bits = i[fit], j[fit], bits[fit]
        swap = (a[4][i] > b[4][j]) | (a[4][i] == b[4][j]) & (a[3][i] > b[3][j])
        one, other = np.where(swap, b[2][j], a[2][i]), np.where(swap, a[2][i], b[2][j])
        order = np.lexsort((other, bits, one))
        one, other = one[order], other[order]
        new = np.r_[True, one[1:] != one[:-1]] if len(one) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        place = np.arange(len(one)) - np.repeat(start, np.diff(np.r_[start, len(one)]))
        more = np.repeat(np.diff(np.r_[start, len(one)]) > most, np.diff(np.r_[start, len(one)]))
        out.append((one[place < most], other[place < most], more[place < most]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))


def near_links(classes: DataFrame, radius: int = RADIUS, whole: int | None = None, most: int | None = None, similarity: float | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links (see ``links``; ``whole`` is given with second halves).

    ``classes`` has distinct fingerprints: node, fp, fp2. Fingerprints of
    equal population count in fp form tiles of bounded size. Tiles are compared
    whole if their counts differ by ``radius`` at most; beyond it no pair can
    link. With ``most``, classes also have component and size, with
    ``similarity`` the size and sketch of a set (many, ``SKETCH``), and the
    edges (a, b, more) are ``proposals``.
    """
    held = ["fp", "fp2", "node"] + (["component", "size"] if most else []) + (["many", *SKETCH] if similarity is not None else [])
    fps = classes.select(F.struct(*held).alias("fp"), F.bit_count("fp").alias("pop"))
    per = {r["pop"]: r["n"] for r in fps.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    if not per:
        return classes.select(F.col("node").alias("a"), F.col("node").alias("b"), *([F.lit(False).alias("more")] if most else [])).limit(0)
    tile = min(MOST, max(LEAST, sum(per.values()) // TILES))
    parts = F.create_map(*(F.lit(x) for p, n in per.items() for x in (p, -(-n // tile))))
    tiles = fps.withColumn("part", F.pmod(F.xxhash64("fp.node"), F.element_at(parts, F.col("pop")))).groupBy("pop", "part").agg(F.collect_list("fp").alias("fps"))
    # A tile goes to every pair that it is part of; the pair (x, x) compares it with itself.
    other = tiles.withColumn("pop2", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pop") - radius), F.least(F.lit(64), F.col("pop") + radius))))
    other = other.where(F.map_contains_key(parts, F.col("pop2"))).withColumn("part2", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("pop2")) - 1)))
    me, it = F.struct(F.col("pop").cast("int"), F.col("part").cast("int")), F.struct(F.col("pop2").cast("int"), F.col("part2").cast("int"))
    sent = other.select(F.least(me, it).alias("x"), F.greatest(me, it).alias("y"), *(F.col("fps")[c].alias(c) for c in held))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key: tuple, pair: pa.Table) -> pa.Table:
        tiles = sorted(([np.asarray(x.values).view(np.uint64) for x in row] for row in zip(*(pair.column(c) for c in held), strict=True)), key=lambda t: len(t[0]))
        if most:
            tiles = [[x.view(np.int64) if k > 1 else x for k, x in enumerate(t)] for t in tiles]
            return pa.table(list(proposals(tiles[0], tiles[1] if len(tiles) > 1 else None, radius, whole, most, similarity)), schema=schema.append(pa.field("more", pa.bool_())))
        (a, a2, own), (b, b2, other) = tiles[0], tiles[1] if len(tiles) > 1 else (None, None, None)
        i, j = links(a, b, radius) if whole is None else links(a, b, radius, a2=a2, b2=b2, whole=whole)
        return pa.table([own[i].view(np.int64), (own if other is None else other)[j].view(np.int64)], schema=schema)

    return sent.groupBy("x", "y").applyInArrow(compare, "a long, b long" + (", more boolean" if most else ""))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of a text's different word shingles; of its whole sequence of words if that is shorter."""
    w = words(text)
    k = min(shingle, len(w))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + k])) for i in range(len(w) - k + 1 if w else 0)), np.uint64))


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shingle_sets(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """node, set (bytes of sorted hashes), its size (many) and ``sketch`` of each node's text."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary()), ("many", pa.int64()), *((c, pa.int64()) for c in SKETCH)])

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ((i, shingle_set(t.as_py(), shingle)) for part in parts for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True))
        yield from batches(((i, x.tobytes(), len(x), *sketch(x).tolist()) for i, x in sets), schema, weight=1)

    return texts.select("node", "text").mapInArrow(hashed, ", ".join(["node long, set binary, many long", *(f"{c} long" for c in SKETCH)]))


def checked(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b), a written table, whose sets of shingles are alike to ``similarity`` or more. ``sets`` has one row a node: node, set."""

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = [alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= similarity for x, y in zip(part.column("x"), part.column("y"), strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    used = save(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
    known = save(sets.select("node", "set").join(used, "node"))
    left = attach(edges, known.select(F.col("node").alias("a"), F.col("set").alias("x"), "n"), ["a"], edges.count()).drop("n")
    left = save(left)
    both = attach(left, known.select(F.col("node").alias("b"), F.col("set").alias("y"), "n"), ["b"], left.count())
    conf, name = edges.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, str(PAIRS_AT_ONCE))
    try:
        return store(both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long"))
    finally:
        conf.set(name, usual)


def linked(classes: DataFrame, forest: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Components (node, component) of all proposed pairs that pass the check.

    A forest holds one link for each part that it joins; where the check cuts
    one, other links may still join its ends. A component that is cut off has
    a refused link that leaves it; so in each round the nodes of such
    components propose their nearest links into others of them that were not
    checked yet, until none has any left; links that the sizes and sketches of
    the sets rule out are not among them. Components without one are whole and
    never looked at again, so a large group of near copies costs a check a
    member; a pair that is never checked lies within one component.
    """
    order = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tested = store(order(forest))
    good = checked(tested, sets, similarity)
    found = components(good)
    nodes = store(tested.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    most = FIRST_PROPOSALS
    while True:
        named = store(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        ends = tested.join(good, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            ends = ends.join(named.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end)
        cut = ends.where("of_a <> of_b").select(F.explode(F.array("of_a", "of_b")).alias("component")).distinct()
        sizes = save(named.groupBy("component").agg(F.count("*").alias("size")).join(cut, "component"))
        if sizes.isEmpty():
            return found
        # Narrow rows, of which only those of cut components are left; a large component is split by the join itself.
        shape = sets.select("node", "many", *SKETCH)
        apart = save(named.join(sizes, "component").join(classes.select("node", "fp", "fp2"), "node").join(shape, "node").select("node", "fp", "fp2", "component", "size", "many", *SKETCH))
        made = store(near_links(apart, FIRST_RADIUS, radius, most, similarity))
        new = store(order(made).join(tested, ["a", "b"], "left_anti"))
        more = checked(new, sets, similarity)
        if not more.isEmpty():
            good = store(good.union(more))
            found = components(good)
        if made.where("more").isEmpty():
            return found  # every link between the components has been checked
        tested = store(tested.union(new))
        most *= MORE_PROPOSALS


def _classes(docs: DataFrame, shingle: int, radius: int, similarity: float | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Saved rows (doc_id, key, node) and classes of equal fingerprints (node, fp, component, n); with ``similarity``, links of wide fingerprints are checked."""
    wide = similarity is not None
    node = F.xxhash64("fp", "fp2") if wide else F.col("fp")
    rows = save(fingerprints(docs, shingle, id_col, text_col, wide).withColumn("node", node))
    classes = save(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.count("*").alias("n"), F.min("key").alias("one")))
    edges = save((near_links(classes, FIRST_RADIUS, radius) if wide else near_links(classes, radius)).distinct())
    if wide:
        ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = save(classes.join(ends, "node").select("node", F.col("one").alias("key")))
        texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
        texts = texts.join(F.broadcast(wanted) if wanted.count() <= MOST_KEYS else wanted, "key").groupBy("node").agg(F.any_value("text").alias("text"))
        found = linked(classes, edges, save(shingle_sets(texts, shingle)), radius, similarity)
    else:
        found = components(edges, "a", "b")
    found = found.withColumnRenamed("node", "linked")
    return rows, save(classes.join(found, classes["node"] == found["linked"], "left").select("node", "fp", "n", F.coalesce("component", "node").alias("component")))


def simhash_groups(docs: DataFrame, shingle: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Equal fingerprints are one class before any comparison. Texts without
    words, and nulls, have fingerprint 0 and link like any other. Repeated
    rows each give a row; null ids have no part in a component's smallest id.
    An empty table gives an empty result; other columns are ignored.
    """
    rows, classes = _classes(docs, shingle, radius, None, id_col, text_col)
    lows = rows.groupBy("node").agg(F.min("doc_id").alias("low"))
    per = classes.join(lows, "node").groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    named = save(attach(classes.withColumnRenamed("n", "rows"), save(per), ["component"], classes.count()).select("node", "fp", "component_id", F.col("rows").alias("n")))
    return attach(rows.select("doc_id", "node"), named, ["node"], rows.count()).select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(docs: DataFrame, shingle: int = 5, radius: int = WIDE_RADIUS, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group of near copies the one with the smallest id.

    Fingerprints have 128 bits here, and the default radius proposes nearly
    all pairs whose shingles are alike to 0.8. A proposed pair links if the
    texts' sets of shingles are alike to ``similarity``; every one is checked
    but those within a group that others hold together already, see
    ``linked``. Texts of equal fingerprints count as alike. Rows, not ids,
    are judged: an id that stands on several texts is no reason to drop any. A
    row without an id stays if no other of its group has one. Of rows alike in
    id and text one stays. Texts without words form one group. An empty table
    gives an empty result.
    """
    rows, classes = _classes(docs, shingle, radius, similarity, id_col, text_col)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    lows = rows.groupBy("node").agg(F.min(first).alias("low"))
    per = save(classes.join(lows, "node").groupBy("component").agg(F.min("low").alias("low"), F.count("*").alias("n")))
    kept = save(attach(classes.withColumnRenamed("n", "rows"), per, ["component"], classes.count()).select("node", F.col("low.key").alias("kept"), F.col("rows").alias("n")))
    judged = attach(rows.select("key", "node"), kept, ["node"], rows.count())
    keys = save(judged.groupBy("key").agg(F.first(F.col("key") == F.col("kept")).alias("stays"), F.count("*").alias("n")))
    return staying(docs, keys, id_col, text_col)

"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.llm.common import WORD, fresh, save

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK = 4096
#: Fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Up to so many sources, their plan is broadcast; it has a row a source.
MOST_SOURCES = 10_000
#: Cells of [0, 1) by which a slot's point finds its source.
CELLS = 1024
#: Rows that one window partition of the running sums holds, about.
CHUNK = 2048


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: key, size, target. ``sizes`` has one row a source: key (null last), size.

    The total to share is ``share`` times all sizes. A source stops at ``cap``
    times its size and the excess goes to the others by weight until none is
    above. The fixed point is a water level: with sources in order of the
    level at which they fill up, a source is full if the level that its
    successors would then share is not below its own.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w)
    up = W.orderBy("full_at", "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy("full_at", "rank").rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = ranked.withColumn("most", F.col("size") * F.lit(cap)).withColumn("full_at", F.col("most") / F.col("weight")).withColumns(
        {"before": F.coalesce(F.sum("most").over(up), F.lit(0.0)), "left": F.sum("weight").over(rest), "total": F.sum("size").over(whole) * F.lit(share)}
    ).withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    final = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(whole)
    return level.withColumn("final", final).select("source", "size", F.least("most", F.coalesce(F.col("final") * F.col("weight"), F.col("most"))).alias("target"))


def _dealt(df: DataFrame, rows: Column) -> DataFrame:
    return df.withColumn("chunk", F.floor((F.pmod(F.col("h"), F.lit(1 << 40)) / F.lit(float(1 << 40))) * rows).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken.

    ``size`` counts the text's words, null as empty; a source may be null.
    Each source's rows stand in a shuffled, repeatable order and form a stream
    that is cut into blocks of ``block`` words. Slot s of the schedule takes
    the source in whose interval of the cumulated targets the fractional part
    of s times the golden ratio falls; a source's k-th slot takes its k-th
    block, and the first again after the last. A source stops inside the block
    where it reaches its target, which two passes always hold as ``cap`` is 2
    at most. ``taken`` counts a row's words in the blocks taken. Rows without
    words take none; repeated rows each have their own place in the stream. An
    empty table gives an empty result; other columns are ignored.
    """
    if not 0 < share <= cap <= 2:
        raise ValueError("needs 0 < share <= cap <= 2")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("th"))
    rows = save(rows.withColumn("h", _place(F.col("id"), F.col("source"), F.col("th"), seed)).drop("th"))
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    per = save(per)
    plan = targets(per.select("source", "size"), share, cap, weights).join(per.select(F.col("source").alias("_s"), "docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Cumulated targets place the sources on [0, 1); quota: the slots that reach a source's target.
    order = W.orderBy(F.col("source").asc_nulls_last())
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    size, goal = F.col("size"), F.col("goal")
    plan = plan.withColumn("goal", F.round("target").cast("long")).withColumn("blocks", F.ceil(size / block)).withColumns({
        "sid": F.row_number().over(order) - 1,
        "hi": F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.greatest(F.sum("target").over(all_), F.lit(1e-300)),
        "quota": F.when(size > 0, F.expr("goal div size") * F.col("blocks") + F.ceil((goal % size) / block)).otherwise(0),
    }).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    plan = save(plan)
    slots, n_rows, n_sources = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.sum("docs"), F.lit(0)), F.count("*")).first()

    # A source's schedule: ranks of its points, by a running count over chunks of slots.
    few = F.broadcast if n_sources <= MOST_SOURCES else lambda df: df
    cell = lambda x: F.floor(F.least(x, F.lit(1.0)) * CELLS)
    bounds = few(plan.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell")))
    steps = max(1, slots // CHUNK)
    point = F.expr(f"(id * {GOLDEN}D) % 1D")
    dealt = _points(rows.sparkSession, slots, point).withColumn("cell", cell(F.col("x"))).join(bounds, "cell").where("x >= lo and x < hi")
    dealt = dealt.select("sid", "slot", F.floor(F.col("slot") * F.lit(steps) / F.lit(max(1, slots))).alias("step"))
    within = dealt.withColumn("k0", F.row_number().over(W.partitionBy("sid", "step").orderBy("slot")) - 1)
    counts = dealt.groupBy("sid", "step").agg(F.count("*").alias("c"))
    prefix = counts.withColumn("base", F.coalesce(F.sum("c").over(W.partitionBy("sid").orderBy("step").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    scheduled = within.join(prefix, ["sid", "step"]).select("sid", "slot", (F.col("base") + F.col("k0")).alias("k"))
    # Points are even but not exact: ranks beyond the quota are left out, missing ones follow the last slot.
    got = dealt.groupBy("sid").agg(F.count("*").alias("got"))
    quota = plan.where("quota > 0").select("sid", "quota", "size", "goal", "blocks")
    short = quota.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    tail = short.select("sid", F.lit(slots).alias("slot"), F.explode(F.sequence("got", F.col("quota") - 1)).alias("k"))
    taken = scheduled.unionByName(tail).join(few(quota), "sid").where("k < quota")
    used = taken.select("sid", "slot", (F.col("k") % F.col("blocks")).alias("block"), *_span(block))
    used = used.groupBy("sid", "block").agg(F.sum(F.col("used")).alias("used"), F.max("used").alias("first"), F.min("slot").alias("slot"))

    # Places of the rows in their source's stream, by a running sum over chunks of the shuffled order.
    of = plan.select("sid", F.col("source").alias("_s"), F.col("size").alias("source_size"), "target", "docs")
    placed = rows.join(few(of), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = save(_dealt(placed, F.greatest(F.lit(1), F.ceil(F.col("docs") / CHUNK))))
    run = W.partitionBy("sid", "chunk").orderBy("h", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("a0", F.coalesce(F.sum("size").over(run), F.lit(0)))
    totals = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("c"))
    start = totals.withColumn("base", F.coalesce(F.sum("c").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
    inside = save(inside.join(start, ["sid", "chunk"]).withColumn("a", F.col("base") + F.col("a0")).withColumn("row", F.struct("chunk", "a0", "h")).select("id", "sid", "size", "source_size", "target", "a", "h"))
    spread = inside.where("size > 0").select("id", "sid", "h", "a", "size", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block))).alias("block"))
    begin = F.col("block") * block
    cover = lambda length: F.greatest(F.lit(0), F.least(F.col("a") + F.col("size"), begin + length) - F.greatest("a", begin))
    part = spread.join(used, ["sid", "block"]).select("sid", "a", (cover(F.col("first")) + cover(F.col("used") - F.col("first"))).alias("taken"), "slot")
    part = part.groupBy("sid", "a").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))
    # Rows without words share their place with the row that follows them, so only rows with words are looked up.
    full = inside.where("size > 0").join(part, ["sid", "a"], "left")
    none = inside.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    return full.unionByName(none.select(full.columns)).select(
        F.col("id").alias(id_col), F.col("size"), "source_size", F.col("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.col("h").alias("place")
    )


def _place(id_: Column, source: Column, text_hash: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_, source, text_hash)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **how) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, all columns: each as often as the words taken make whole copies of it, rounded.

    Rows without words stay once. Rows alike in id, source and text share
    what the mix takes of them evenly. An empty table gives an empty result;
    other columns stay as they are, whatever their names.
    """
    place, copies, copy = fresh(docs, "_place", "_copies", "_copy")
    share = mix(docs, id_col, text_col, source_col, seed=seed, **how).groupBy("place").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    often = share.select(F.col("place").alias(place), F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(copies))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.withColumn(place, _place(F.col(id_col), F.col(source_col).cast("string"), F.xxhash64(text), seed))
    return named.join(often.where(F.col(copies) > 0), place).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)


def _points(spark, slots: int, point: Column) -> DataFrame:
    return spark.range(slots).select(F.col("id").alias("slot"), point.alias("x"))


def _span(block: int) -> list[Column]:
    """Words that a slot uses of its block: all, but in the last slot what is left to the target."""
    at, k = F.col("k") % F.col("blocks"), F.floor(F.col("k") / F.col("blocks"))
    length = F.least(F.lit(block), F.col("size") - at * block)
    return [F.greatest(F.lit(0), F.least(length, F.col("goal") - k * F.col("size") - at * block)).alias("used")]

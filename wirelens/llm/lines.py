"""Line dedup: runs of lines that repeat, found by winnowing over line hashes and extended both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wirelens.llm.common import attach, save

#: A run is deleted if it has so many lines or so many words.
LEAST_LINES, LEAST_WORDS = 2, 50


def _text(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """Text, and the two hashes that name a row: of its id with its text, and of its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return text, F.xxhash64(id_col, text), F.xxhash64(text)


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that have words, of every row: id, key, th, line (from 0, among all lines), h, words.

    Lines are alike if their words are. Null texts have none.
    """
    text, key, th = _text(docs, id_col, text_col)
    lines = docs.select(F.col(id_col).alias("id"), key.alias("key"), th.alias("th"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    plain = lines.withColumn("t", F.trim(F.regexp_replace("t", r"[\x20\x09-\x0D]+", " "))).where("t <> ''")
    words = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
    return plain.select("id", "key", "th", "line", F.xxhash64("t").alias("h"), words.cast("long").alias("words"))


def fingerprints(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Chosen lines, with the neighbours that a match may extend to: kind, g, other, side, id, key, th, n, own, and the lines there.

    The winnowing window has two lines, so that a repeated run of two lines,
    wherever it stands, holds a chosen line: the smaller hash of each two
    neighbours (``g``, kind 2). A row has the chosen line's number (``own``)
    and one neighbour: its hash (``other``) and whether it stands behind
    (``side`` 1) or before. A line of ``least_words`` words is chosen by
    itself (kind 1).
    """
    doc = W.partitionBy("key", "th").orderBy("line")
    # Rows alike in id and text are one document.
    once = lines.withColumn("_p", F.lag("line").over(doc)).where("_p is null or _p <> line").drop("_p")
    near = once.withColumn("n", F.row_number().over(doc)).withColumn("at", F.struct("line", "words"))
    near = near.withColumns({"h_next": F.lead("h").over(doc), "at_next": F.lead("at").over(doc)})
    first = F.col("h") <= F.col("h_next")
    pair = F.struct(F.lit(2).alias("kind"), F.least("h", "h_next").alias("g"), F.greatest("h", "h_next").alias("other"), first.cast("int").alias("side"), F.when(first, F.col("n")).otherwise(F.col("n") + 1).alias("own"))
    alone = F.struct(F.lit(1).alias("kind"), F.col("h").alias("g"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("side"), F.col("n").alias("own"))
    found = near.withColumn("k", F.explode(F.array_compact(F.array(F.when(F.col("h_next").isNotNull(), pair), F.when(F.col("words") >= least_words, alone)))))
    return found.select("k.*", "id", "key", "th", "n", "at", F.when(F.col("k.kind") == 2, F.col("at_next")).alias("at_next"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """key, th and line of every line that belongs to a later repeat of a run.

    Places of chosen lines that have one place alone are let go of first. The
    others are extended by the neighbour on either side: a match is a later
    place whose neighbour is also that of an earlier place, the first of them
    in order of id, text hash and line being the origin. Each later place is
    joined to the origin alone, so a line that many documents share gives a
    row a place and no pairs; and an extension is tried against all earlier
    places at once, as it is part of the key. Matched lines that follow one
    another, extended from one chosen line or from several, form a run, which
    repeats if it has ``least_lines`` lines or ``least_words`` words. The first
    place of any line always stays.
    """
    found = save(fingerprints(text_lines(docs, id_col, text_col), least_words))
    chosen = F.struct("id", "th", "own")
    places = found.groupBy("kind", "g").agg((F.min(chosen) != F.max(chosen)).alias("again"), F.count("*").alias("size"))
    again = save(places.where("again").select("kind", "g", "size"))
    open_ = save(attach(found, again, ["kind", "g"], found.count(), "size").where("size is not null").drop("size"))
    place, extended = F.struct("id", "th", "n"), ["kind", "g", "other", "side"]
    origin = open_.groupBy(*extended).agg(F.min(place).alias("place"), F.count("*").alias("size"))
    origin = save(origin.where("size > 1"))
    # Only later places: the origin itself matches nothing.
    matched = attach(open_, origin, extended, open_.count(), "size").where(F.col("place").isNotNull() & (place != F.col("place")))
    step = lambda at, k: F.when(at.isNotNull(), F.struct((F.col("n") + k).alias("n"), at["line"].alias("line"), at["words"].alias("words")))
    covered = F.array_compact(F.array(step(F.col("at"), F.lit(0)), step(F.col("at_next"), F.lit(1))))
    rows = matched.select("key", "th", F.explode(covered).alias("c")).groupBy("key", "th", "c.n").agg(F.max("c.line").alias("line"), F.max("c.words").alias("words"))
    runs = rows.withColumn("run", F.col("n") - F.row_number().over(W.partitionBy("key", "th").orderBy("n")))
    run = W.partitionBy("key", "th", "run")
    return runs.withColumns({"_n": F.count("*").over(run), "_w": F.sum("words").over(run)}).where((F.col("_n") >= least_lines) | (F.col("_w") >= least_words)).select("key", "th", "line")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, text without later repeats of runs of lines, n_lines, n_removed.

    Null texts become empty. Lines without words stay. Rows alike in id and
    text are treated alike. An empty table gives an empty result; other
    columns are ignored.
    """
    gone = save(repeated_lines(docs, id_col, text_col, least_lines, least_words).groupBy("key", "th").agg(F.collect_set("line").alias("gone")))
    text, key, th = _text(docs, id_col, text_col)
    split = docs.select(F.col(id_col), key.alias("key"), th.alias("th"), F.split(text, "\n").alias("lines"))
    joined = split.join(gone, ["key", "th"], "left")
    n = F.size("lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("gone", F.array().cast("array<int>")))
    rebuilt = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    return joined.select(id_col, rebuilt.alias(text_col), n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))

"""Small tables with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def texts(seed: int = 0, n: int = 120) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ß", "é", "ing", "ly"]) for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    made: list[str | None] = [None, "", "   \n\t", "One", "a b c", "ONE", "one", "漢字 😀  x", "x" * 5000]
    for _ in range(n):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        made.append("\n".join(lines))
    made += made[20:30] + [t.upper() for t in made[30:34]]  # copies, also but for case
    made += [t + " more" for t in made[34:40] if t]  # near copies
    made.append(" ".join(rng.choice(words) for _ in range(30_000)))  # very long
    return made


def documents(spark, seed: int = 0, n: int = 120, repeat: bool = True, extra: bool = True):
    sources = ["s1", "s2", "s3", None, "s4"]
    rows = [(i, t, "en", sources[i % 5] if i % 3 else "s1", None if t is None else len(t)) for i, t in enumerate(texts(seed, n))]
    if repeat:
        rows += rows[40:43]  # rows repeated whole
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if extra:
        for name in ("n", "id", "h", "fp", "size", "kept", "slot", "row", "key", "line", "bucket", "page", "_t", "_id", "_place", "_copies", "_copy", "_prefix", "_alive", "_sha", "_row", "_key", "_stays"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def odd_rows(spark):
    """Ids that stand on several texts, ids that are null, rows repeated whole, and a text that only rows without an id have."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [
        (5, "a"), (7, "A"), (5, "b"), (None, "a"), (None, "b"), (None, "c only"), (None, "c only"), (9, "d"), (9, "d"), (3, base), (5, base + " more"), (5, "another text"), (None, base), (11, None), (12, ""), (None, None),
    ]
    return spark.createDataFrame([(i, t, "en", "s1", None) for i, t in rows], DOCS)

import random
import zlib

import pytest

from tests.llm.fixtures import documents, empty
from wirelens.llm import toxicity

INSULTS = ["grobnik", "worthless", "fleezard", "mudbrain"]


def garbled(rng, w):
    k = rng.randrange(4)
    return w if k == 0 else w.upper() if k == 1 else w[:3] + rng.choice("-*.x") + w[3:] if k == 2 else w.replace("o", "0").replace("e", "3")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ing", "ly", "sol", "mar"]) for _ in range(rng.randrange(1, 4))) for _ in range(200)]
    rows = []
    for i in range(900):
        label = int(i % 5 == 0)
        said = [[rng.choice(words) for _ in range(rng.randrange(5, 15))] for _ in range(4)]
        for s in said[:3] if label else []:
            s[rng.randrange(len(s))] = garbled(rng, rng.choice(INSULTS))
        rows.append((i, ". ".join(" ".join(s) for s in said) + ".", label))
    return rows


def test_held_out_accuracy_and_labels(spark, corpus):
    docs = spark.createDataFrame([r[:2] for r in corpus] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(corpus) + 2
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in corpus if got[i].held_out]
    assert sum(p and not y for p, y in held) <= 2
    assert sum(p and y for p, y in held) >= 0.85 * sum(y for _, y in held)
    assert got[5000].score == got[5001].score < 0.5
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    # A held-out label changes nothing.
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in corpus], "doc_id long, toxic int")
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_kernel_tolerates_gaps_and_insertions():
    row, code, value = toxicity.triples(["mudbrain", "mud-br*ain", "mudxbrain", "harmony"])
    dense = [dict.fromkeys([], 0.0) for _ in range(4)]
    for r, c, v in zip(row.tolist(), code.tolist(), value.tolist(), strict=True):
        dense[r][c] = dense[r].get(c, 0) + v
    like = lambda a, b: sum(v * dense[b].get(c, 0) for c, v in dense[a].items())
    assert like(0, 1) > 0.99 and like(0, 2) > 0.5 > like(0, 3)


def test_odd_tables(spark, corpus):
    df = documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(df, none)
    assert out.count() == df.count()
    assert toxicity.keep_clean(df, none).columns == df.columns
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(df, odd).count() == df.count()
    assert toxicity.toxicity(empty(spark), odd).count() == 0

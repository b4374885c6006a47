import re
from collections import Counter

import pytest

from tests.llm.fixtures import documents, empty
from wirelens.llm import mixing


def brute_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        rest = share * sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_mix(spark, block):
    df = documents(spark)
    rows = df.collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    goal = brute_targets(sizes)
    got = mixing.mix(df, block=block).collect()
    assert len(got) == len(rows)
    source = {r.doc_id: r.source for r in rows}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == words[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix(df.repartition(5), block=block).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_slots_follow_the_targets_evenly(spark):
    got = mixing.mix(documents(spark), block=16)
    first = got.where("first_slot is not null").selectExpr("min(first_slot)", "max(first_slot)").first()
    assert first[0] <= 3 and first[1] > 10


def test_mixed_copies_rows(spark):
    df = documents(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken / max(1, r.size)
    often = Counter(r.doc_id for r in out.collect())
    repeated = Counter(r.doc_id for r in df.collect())
    for r in df.dropDuplicates(["doc_id"]).collect():
        if (r.text or "").strip(" \t\n") == "":
            assert often[r.doc_id] == 1
        else:
            assert abs(often[r.doc_id] - taken[r.doc_id]) <= 0.51 * repeated[r.doc_id]


def test_empty_tables_and_bad_choices(spark):
    assert mixing.mix(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.mix(nothing).collect()) == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(empty(spark), share=3.0)

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, empty
from wirelens.llm import decontaminate as d

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    ws, hit, found = brute_words(text), set(), set()
    for item, t in items:
        its = brute_words(t)
        size = min(10, len(its))
        for a in range(len(its) - size + 1) if its else ():
            for b in range(len(ws) - size + 1):
                if ws[b : b + size] == its[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(item)
    return len(ws), len(hit), sorted(found), hit


@given(st.lists(st.sampled_from("ab"), min_size=10, max_size=40), st.integers(0, 30))
@settings(max_examples=200, deadline=None)
def test_shared_windows_share_their_fingerprint(middle, before):
    """The guarantee: windows with the same words have the same fingerprint wherever they stand."""
    inner = d.hashes([w.encode() for w in middle])
    outer = d.hashes([b"x%d" % i for i in range(before)] + [w.encode() for w in middle] + [b"y"])
    for size in (*range(1, 10), d.WINDOW):
        a, b = d.minima(inner, size), d.minima(outer, size)
        assert np.array_equal(a, b[before : before + len(a)])


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string, id string, g long, size string, row int, n_words string")


def test_against_all_windows(spark):
    rng = random.Random(4)
    df = documents(spark).cache()
    rows = [r for r in df.collect() if r.text and len(r.text) < 5000]
    items = [("none", None), ("blank", " ,.; "), ("one", "One"), ("abc", "a, B c"), (None, "漢字 x"), ("x", rows[20].text), ("x", "a b c"), ("twin", rows[20].text)]
    for k in range(12):
        ws = brute_words(rng.choice(rows).text) or ["z"]
        a = rng.randrange(len(ws))
        items.append((f"i{k}", "; ".join(ws[a : a + rng.choice([3, 5, 7, 9, 10, 11, 25])]).upper()))
    bench = items_of(spark, [(i, t, "clash", 1, "clash", 2, "clash") for i, t in items])
    want = {r.doc_id: brute(r.text, [(i or "", t) for i, t in items]) for r in df.collect() if r.text is None or len(r.text) < 50_000}
    got = d.contamination(df, bench).collect()
    assert len(got) == df.count()
    assert sum(r.n_hit > 0 for r in got) > 15
    for r in got:
        if r.doc_id in want:
            n, hits, found, at = want[r.doc_id]
            assert (r.n_words, r.n_hit, r["items"]) == (n, hits, found), r.doc_id
            assert {i for s in r.spans for i in range(s.start, s.end)} == at


def test_a_filter_that_lets_all_pass_and_a_shuffled_join_change_nothing(spark, monkeypatch):
    df = documents(spark, n=40)
    bench = items_of(spark, [(f"i{r.doc_id}", r.text, "", 1, "", 2, "") for r in df.where("doc_id between 12 and 25").collect()])
    want = sorted(map(str, d.contamination(df, bench).collect()))
    monkeypatch.setattr(d, "MOST_WINDOWS", -1)
    assert sorted(map(str, d.contamination(df, bench).collect())) == want
    monkeypatch.setattr(d, "FILTER_BITS", 6)
    assert sorted(map(str, d.contamination(df, bench).collect())) == want


def test_no_items_and_no_documents(spark):
    bench = items_of(spark, [("a", "one two three four", "", 1, "", 2, "")])
    assert d.digest(d.contamination(empty(spark), bench)).collect() == []
    got = d.digest(d.contamination(documents(spark), bench.where("false"))).collect()
    assert got and not any(r.contaminated or r.n_items or r.n_hit for r in got)

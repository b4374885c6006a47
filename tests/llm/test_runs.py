import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, empty
from wirelens.llm import runs


def brute(ws):
    """All runs by definition: maximal stretches of each period, the smallest of those that cover the same words."""
    n, found = len(ws), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if ws[i] != ws[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and ws[i] == ws[i + p]:
                i += 1
            if i + p - a >= max(12, 2 * p):
                found.setdefault((a, i + p), p)
    return sorted((a, z - a, p) for (a, z), p in found.items())


def brute_collapsed(ws, found):
    gone = {i for a, size, p in found for i in range(a + p, a + size)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def found_in(texts):
    sizes = np.array([len(t) for t in texts])
    flat = np.array([w for t in texts for w in t], np.int64)
    out = [[] for _ in texts]
    for t, a, size, p in zip(*(x.tolist() for x in runs.runs_of(flat, sizes)), strict=True):
        out[t].append((a, size, p))
    return out


parts = st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=6), st.integers(1, 9)), max_size=6)


@given(st.lists(parts, min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_runs_by_definition(many):
    texts = [[w for unit, k in t for w in unit * k] for t in many]
    assert found_in(texts) == [brute(t) for t in texts]


def test_small_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [list(np.tile(rng.integers(0, 3, rng.integers(1, 9)), rng.integers(1, 12))) + list(rng.integers(0, 2, 30)) for _ in range(60)]
    want = [brute(t) for t in texts]
    assert found_in(texts) == want
    monkeypatch.setattr(runs, "PAIRS", 5)
    monkeypatch.setattr(runs, "WORDS", 50)
    assert found_in(texts) == want


@given(st.lists(st.integers(0, 1), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_extensions(symbols):
    s = np.array([*symbols, -1])
    e = runs.Extensions(s)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
    a, b = a[a != b], b[a != b]
    want = [next(k for k in range(len(s)) if s[i + k] != s[j + k]) for i, j in zip(a, b, strict=True)]
    assert e.lengths(a, b).tolist() == want


def test_a_very_long_text_of_one_word():
    assert found_in([[7] * 200_000, [1, 2] * 50_000]) == [[(0, 200_000, 1)], [(0, 100_000, 2)]]


def planted_words(r):
    ws, h = (r.text or "").encode().split(), zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
    g, n = h // 10, len(ws)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in ws]


def test_query_columns(spark):
    df = documents(spark, n=200).cache()
    got = runs.digest(runs.periodic_runs(runs.planted(df))).collect()
    rows = [r for r in df.collect() if r.text is None or len(r.text) < 30_000]
    want = []
    for r in rows:
        ws = planted_words(r)
        found = brute(ws)
        m = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(found), *(m or (None,) * 3), m and 1000 * m[1] // m[2], sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(brute_collapsed(ws, found))))
    assert len(got) == df.count()
    ids = {r.doc_id for r in rows}
    assert sorted(map(str, (tuple(g) for g in got if g.doc_id in ids))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 10


def test_odd_tables(spark):
    assert runs.digest(runs.periodic_runs(runs.planted(empty(spark)))).collect() == []
    df = spark.createDataFrame([(None, "a b " * 9, 1), (None, None, 1), (5, " \n", 1)], "doc_id long, text string, runs int")
    got = {(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in runs.periodic_runs(df).collect()}
    assert got == {(None, 18, ((0, 18, 2),), "a b"), (None, 0, (), ""), (5, 0, (), "")}

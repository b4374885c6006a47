import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import documents, empty, odd_rows
from wirelens.llm import simhash


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


@pytest.mark.parametrize("shingle", [4, 5])
def test_groups_equal_brute_force(spark, shingle):
    df = documents(spark, n=60)
    texts = {r.doc_id: r.text for r in df.collect()}
    fps = {i: brute_fingerprint(t, shingle) for i, t in texts.items() if t is None or len(t) < 50_000}
    got = simhash.simhash_groups(df, shingle)
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        if r.doc_id in fps:
            assert r.fingerprint == f"{fps[r.doc_id]:016x}"
    full = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert {r.doc_id: r.component_id for r in rows} == brute_components(sorted(full), full, 4)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(1, 300), st.booleans())
def test_links_keep_all_components(seed, m, n, own):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    draw = lambda k: centres[rng.integers(0, 5, k)] ^ (np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))
    a = np.unique(draw(m))
    b = None if own else np.unique(draw(n))
    i, j = simhash.links(a, b, step=16)
    other = a if own else b
    assert (np.bitwise_count(a[i] ^ other[j]) <= 4).all()
    nodes = len(a) + (0 if own else len(b))
    assert len(i) < nodes

    def parts(edges):
        low = list(range(nodes))
        for p, q in edges:
            x, y = low[p], low[q]
            if x != y:
                low = [min(x, y) if z in (x, y) else z for z in low]
        return low

    shift = 0 if own else len(a)
    all_pairs = [(p, q + shift) for p in range(len(a)) for q in range(len(other)) if (p < q or not own) and (a[p] ^ other[q]).item().bit_count() <= 4]
    assert parts(all_pairs) == parts([(int(p), int(q) + shift) for p, q in zip(i, j, strict=True)])


def test_a_chain_and_a_large_group(spark):
    # A chain of fingerprints each 4 bits from the next, across population counts, and a dense group.
    fps = [sum(1 << b for b in range(4 * k)) for k in range(17)] + [(1 << 63 | 1 << k) for k in range(30, 62)]
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long").selectExpr("fp", "0L AS fp2", "fp AS node")
    edges = {(r.a, r.b) for r in simhash.near_links(df).collect()}
    assert len(edges) < 3 * len(fps)
    from wirelens.llm.common import components

    found = {r.node: r.component for r in components(simhash.near_links(df)).collect()}
    chain = {f - (f >> 63 << 64) for f in fps[:17]}
    assert len({found[f] for f in chain}) == 1 and len({found[f - (1 << 64)] for f in fps[17:]}) == 1


def test_empty_table(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0 and simhash.near_dedup(empty(spark)).count() == 0


def brute_kept(rows, link):
    """The first row of each component, in order of id (null last) and key."""
    rows = sorted({(r.doc_id is None, r.doc_id, (r.text or "") if r.text is not None else None) for r in rows}, key=str)
    low = list(range(len(rows)))
    fps = [(simhash.fingerprint(t, 5, wide=True), simhash.shingle_set(t)) for _, _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if link(fps[i], fps[j]) and low[i] != low[j]:
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    groups = {}
    for row, x in zip(rows, low, strict=True):
        groups.setdefault(x, []).append(row)
    return sorted((min(g, key=lambda r: (r[0], r[1] or 0))[:2] for g in groups.values()), key=str)


def wide_link(x, y):
    """As ``links`` proposes pairs of (fingerprint, set of shingles), and ``checked`` checks them."""
    d = x[0] ^ y[0]
    return (d >> 64).bit_count() <= simhash.FIRST_RADIUS and d.bit_count() <= simhash.WIDE_RADIUS and (d == 0 or simhash.alike(x[1], y[1]) >= 0.8)


def test_dedup_judges_rows_not_ids(spark):
    for df in (odd_rows(spark), documents(spark, n=50)):
        out = simhash.near_dedup(df)
        assert out.columns == df.columns
        got = sorted(((r.doc_id is None, r.doc_id) for r in out.collect()), key=str)
        assert got == brute_kept(df.collect(), wide_link)
    texts = sorted(str(r.text) for r in simhash.near_dedup(odd_rows(spark)).collect())
    assert "another text" in texts and "c only" in texts and texts.count("d") == 1


def test_near_copies_are_found_and_others_left_alone(spark):
    """Against five-word-shingle similarity of all pairs."""
    rng = np.random.default_rng(4)
    word = lambda k: [f"x{v}" for v in rng.integers(0, 3000, k)]
    rows = []
    for _ in range(60):
        base = word(int(rng.integers(40, 400)))
        rows.append(base)
        for _ in range(2):
            copy = list(base)
            for _ in range(int(rng.integers(1, max(2, len(base) // 90)))):
                copy[int(rng.integers(0, len(copy)))] = "new"
            rows.append(copy)
    texts = [" ".join(r) for r in rows]
    got = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    pairs = [(j, i) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = list(range(len(rows)))
    for j, i in pairs:
        low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    expected = set(low)
    assert len(pairs) > 80 and len(got ^ expected) <= 0.05 * len(pairs)
    assert expected <= got  # nothing goes that is not alike


def families(rng, n, size, vocabulary=4000):
    """Texts that drift: each member is made of an earlier one by changes that leave a similarity on either side of 0.8."""
    rows = []
    for _ in range(n):
        base = [f"x{v}" for v in rng.integers(0, vocabulary, int(rng.integers(60, 300)))]
        own = [base]
        while len(own) < size:
            copy = list(own[int(rng.integers(0, len(own)))])
            for _ in range(int(rng.integers(1, max(2, len(base) // 20)))):
                copy[int(rng.integers(0, len(copy)))] = f"n{rng.integers(0, 10**9)}"
            own.append(copy)
        rows += own
    return rows


def kept_by_all_pairs(rows, similarity=0.8):
    sets = [{tuple(r[i : i + 5]) for i in range(len(r) - 4)} for r in rows]
    by, low = {}, list(range(len(rows)))
    for i, x in enumerate(sets):
        for g in x:
            by.setdefault(g, []).append(i)
    top = lambda k: k if low[k] == k else top(low[k])
    pairs = {(i, j) for own in by.values() for i in own for j in own if i < j}
    near = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    for i, j in near:
        a, b = top(i), top(j)
        low[max(a, b)] = min(a, b)
    return {k for k in range(len(rows)) if top(k) == k}, len(near)


def test_no_link_is_lost_in_families(spark):
    """Families whose members are alike to about 0.8: the rows that stay are those of all pairs compared by their shingles."""
    rows = families(np.random.default_rng(8), 60, 20)
    expected, n = kept_by_all_pairs(rows)
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in simhash.near_dedup(df).collect()}
    assert n > 700 and len(expected) > 600
    assert got == expected


def test_proposals_are_all_links_into_other_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, (6, 2), dtype=np.uint64)
    flip = lambda k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))
    fps = np.array([[b[0] ^ flip(4), b[1] ^ flip(5)] for b in base for _ in range(12)], np.uint64)
    node, comp = np.arange(len(fps)) + 500, rng.integers(0, 9, len(fps))
    size = np.bincount(comp)[comp]
    tile = lambda k: [fps[k, 0], fps[k, 1], node[k], comp[k], size[k]]
    bits = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
    want = {(min(x, y) + 500, max(x, y) + 500) for x in range(len(fps)) for y in range(x) if bits[x, y, 0] <= 9 and bits[x, y].sum() <= 17 and comp[x] != comp[y]}
    half = np.arange(len(fps)) % 2 == 0
    for most in (1, 3, 1000):
        got = [simhash.proposals(tile(half), None, 9, 17, most), simhash.proposals(tile(~half), None, 9, 17, most), simhash.proposals(tile(half), tile(~half), 9, 17, most)]
        pairs = {(min(a, b), max(a, b)) for one, other, _ in got for a, b in zip(one.tolist(), other.tolist(), strict=True)}
        assert pairs <= want and (pairs == want) == (not any(more.any() for *_, more in got)) and (most < 1000 or pairs == want)
        for one, other, _ in got:
            assert all((size[a - 500], comp[a - 500]) < (size[b - 500], comp[b - 500]) for a, b in zip(one, other, strict=True))
            assert not len(one) or np.unique(one, return_counts=True)[1].max() <= most


def test_sketches_rule_out_no_pair_that_is_alike_and_most_others():
    rng = np.random.default_rng(5)
    for size in (0, 1, 7, 60, 400, 6000):
        sets = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))]
        for share in (0.02, 0.1, 0.11, 0.112, 0.2, 0.4):
            old = sets[0][rng.random(size) > share]
            sets += [old, np.unique(np.concatenate([old, rng.integers(0, 1 << 63, size - len(old)).astype(np.uint64)]))]
        tile = [np.array([len(x) for x in sets]), *np.stack([simhash.sketch(x) for x in sets], 1)]
        i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
        near = np.array([simhash.alike(sets[p], sets[q]) for p, q in zip(i, j, strict=True)])
        may = simhash.may_be_alike(tile, i, tile, j, 0.8)
        assert may[near >= 0.8].all()
        if 60 <= size <= 400:
            assert not may[near < 0.6].any()


def test_proposals_leave_out_what_sketches_rule_out():
    """A group of texts whose fingerprints are equal in all but few bits, and whose sets have little in common: no pair of them is proposed."""
    rng = np.random.default_rng(6)
    n = 60
    sets = [np.unique(rng.integers(0, 1 << 63, 50).astype(np.uint64)) for _ in range(n - 1)]
    sets.append(sets[0])
    shape = [np.array([len(x) for x in sets]), *np.stack([simhash.sketch(x) for x in sets], 1)]
    tile = [np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.arange(n), np.arange(n), np.ones(n, np.int64)]
    assert len(simhash.proposals(tile, None, 20, 32, n)[0]) == n * (n - 1) // 2
    one, other, more = simhash.proposals([*tile, *shape], None, 20, 32, n, 0.8)
    assert {one[0], other[0]} == {0, n - 1} and len(one) == 1 and not more.any()

import hashlib
import zlib
from collections import defaultdict

import pytest

from tests.llm.fixtures import documents, empty, odd_rows
from wirelens.llm import merkle


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(r, more=0):
    values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, fanout):
    """Root, and the (before, after) siblings of each leaf, by plain lists."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // fanout * fanout
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def brute(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, brute_leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in langs}
    root, high = brute_tree([trees[g][0] for g in langs], fanout)
    out = []
    for g, above in zip(langs, high, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            path = path + above
            change = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 0
            node = brute_leaf(r, 1) if change else leaf
            for a, b in path:
                node = sha(a + node + b)
            out.append((r.doc_id, leaf, trees[g][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def with_langs(df, n):
    return df.selectExpr("doc_id", "text", f"CASE WHEN doc_id % {n} = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'en' ELSE concat('ü', doc_id % {n}) END AS lang", "source", "n_chars")


@pytest.mark.parametrize(("levels", "fanout"), [(2, 2), (11, 2), (2, 3)])
def test_every_proof_by_brute_force(spark, levels, fanout):
    df = with_langs(documents(spark), 5).cache()
    rows = merkle.manifest(df, fanout=fanout, levels=levels).collect()
    want = brute(df.collect(), fanout)
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, sha("".join(a + b for a, b in zip(r.before, r.after, strict=True)))) for r in rows) == sorted(w[:5] for w in want)


def test_tampering_is_found(spark):
    for df in (documents(spark), with_langs(documents(spark, n=300), 7), odd_rows(spark)):
        df = df.cache()
        got = sorted((tuple(r) for r in merkle.tamper_check(df).collect()), key=str)
        assert got == brute(df.collect())
        # Only a changed row fails, and rows without a count can't be changed.
        failed = {r[0] for r in got if not r[6]}
        assert failed == {r.doc_id for r in df.collect() if r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0}


def test_one_row_and_no_rows(spark):
    df = documents(spark, extra=False).where("doc_id = 3")
    (row,) = merkle.manifest(df).collect()
    assert row.leaf == row.subroot == row.root and row.before == [] and row.after == []
    assert merkle.tamper_check(empty(spark)).collect() == []


def test_rows_repeated_whole_are_leaves_each(spark):
    """A third of the rows alike: they are spread over partitions, and each has its own place."""
    row = documents(spark, extra=False).where("doc_id = 9")
    df = row
    for _ in range(6):
        df = df.union(df)
    rows = merkle.manifest(df, levels=2).collect()
    assert sorted(r.ix for r in rows) == list(range(64)) and len({r.root for r in rows}) == 1

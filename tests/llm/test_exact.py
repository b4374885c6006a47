import hashlib
import string
from collections import defaultdict

from tests.llm.fixtures import documents, empty, odd_rows
from wirelens.llm import exact

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_groups_equal_brute_force(spark):
    df = documents(spark)
    groups = defaultdict(list)
    for r in df.collect():
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    expected = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted(map(tuple, exact.exact_groups(df, digest=True).collect())) == expected
    # Without digest only texts that survive to the last step are hashed, with the same groups.
    assert sorted(tuple(r)[:4] for r in exact.exact_groups(df).collect()) == [e[:4] for e in expected]


def test_dedup_keeps_one_row_a_text(spark):
    df = documents(spark)
    kept = exact.exact_dedup(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    folded = [(r.text or "").translate(FOLD) for r in rows]
    assert len(set(folded)) == len(folded) == len({(r.text or "").translate(FOLD) for r in df.collect()})


def test_hot_group_and_empty_table(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(900)], "doc_id long, text string")
    got = exact.exact_groups(df).where("group_size > 1").selectExpr("count(*)", "min(keep_id)", "max(group_size)").first()
    assert tuple(got) == (600, 899, 600)
    assert exact.exact_groups(empty(spark)).count() == 0 and exact.exact_dedup(empty(spark)).count() == 0


def brute(rows):
    """One row a text: that with the largest id, null being the smallest."""
    best = {}
    for r in rows:
        key = (r.text or "").translate(FOLD)
        if key not in best or (r.doc_id is not None and (best[key] is None or r.doc_id > best[key])):
            best[key] = r.doc_id
    return sorted(best.items(), key=str)


def kept(df):
    return sorted((((r.text or "").translate(FOLD), r.doc_id) for r in df.collect()), key=str)


def test_rows_are_judged_not_ids(spark, monkeypatch):
    for df in (odd_rows(spark), documents(spark)):
        expected = brute(df.collect())
        assert kept(exact.exact_dedup(df)) == expected
        with monkeypatch.context() as m:
            m.setattr(exact, "MOST_KEYS", -1)  # too many groups to broadcast
            assert kept(exact.exact_dedup(df)) == expected
            above = sorted(map(str, exact.exact_groups(df).collect()))
        assert above == sorted(map(str, exact.exact_groups(df).collect())) and len(above) == df.count()


def test_the_hash_is_left_out_alike_at_every_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Aa"), (2, "aA"), (3, "bcd"), (4, None), (5, "x" * 200 + "a"), (6, "x" * 200 + "b")], "doc_id long, text string")
    want = {(1, 2, True), (2, 2, True), (3, 3, False), (4, 4, False), (5, 5, True), (6, 6, True)}
    for most in (1 << 19, -1):
        monkeypatch.setattr(exact, "MOST_KEYS", most)
        assert {(r.doc_id, r.keep_id, r.text_sha256 is not None) for r in exact.exact_groups(df).collect()} == want
        plan = exact.exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "max_by" not in plan  # the rows that stay are read where they are

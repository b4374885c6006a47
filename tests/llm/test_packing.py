import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, empty, texts
from wirelens.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_places_are_gapless_and_fit(sizes):
    bins, offsets = packing.place(np.array(sizes, np.int64), 100)
    of = defaultdict(list)
    for s, b, o in zip(sizes, bins, offsets, strict=True):
        of[b].append((o, s))
    for items in of.values():
        at = 0
        for o, s in sorted(items):
            assert o == at
            at += s
        assert at <= 100
        assert sum(3 * s > 100 for _, s in items) <= 2


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(0)
    sizes = np.minimum(2048, rng.lognormal(5.5, 1.2, 4000).astype(np.int64) + 1)
    bins, _ = packing.place(sizes, 2048)
    assert len(set(bins)) <= -(-sizes.sum() // 2048) + 2


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab .\n'sé漢0\t ", max_size=40))
def test_both_tokenizers_agree(text):
    assert packing.encode(text, JSON, RANKS).tolist() == packing.encode(text, JSON, None).tolist()


def test_ids_are_those_of_the_stated_call():
    """Also where a text holds a special token's name: ids, as the tokenizer's file alone gives them."""
    bare = Tokenizer.from_file(JSON)
    for text in ["a <|endoftext|> b", "<|endoftext|>", "plain words", "é 漢 <|endoftext|>x<|endoftext|>", "a <|endof text|>", ""]:
        assert packing.encode(text, JSON, RANKS).tolist() == packing.encode(text, JSON).tolist() == bare.encode(text, add_special_tokens=False).ids
    assert 50256 in packing.encode("a <|endoftext|> b", JSON, RANKS) and 50256 not in packing.encode("a <|endoftext|> b", JSON, RANKS, special=False)


def test_sequences_on_real_lengths(spark):
    pieces = packing.token_pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), JSON, RANKS)
    tokens, sequences = packing.pack(pieces).selectExpr("sum(length)", "count(DISTINCT sequence_id)").first()
    assert sequences <= -(-tokens // 2048) + 2


@pytest.mark.parametrize(("n", "expected"), [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]), (25, [(0, 5), (5, 10), (15, 10)])])
def test_cut(n, expected):
    assert packing.cut(n, 10) == expected


def test_pieces_and_sequences(spark):
    df = documents(spark)
    pieces = packing.token_pieces(df, JSON, RANKS, with_ids=True)
    got = packing.pack(pieces, group=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r in df.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*packing.encode(r.text, JSON, None), 0], "<u4")
        own = sorted({(p.piece, p.start, p.length, p.ids_crc32, tuple(np.frombuffer(p.ids, '<u2').tolist())) for p in by[r.doc_id]})
        assert [x for p in own for x in p[4]] == ids.tolist()
        assert all(crc == zlib.crc32(ids[a : a + n].tobytes()) for _, a, n, crc, _ in own)
    assert len(got) == pieces.count()
    of = defaultdict(list)
    for r in got:
        of[r.sequence_id].append((r.offset, r.length))
    for items in of.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 2048


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(empty(spark), JSON, RANKS)).count() == 0
    assert any(t is None for t in texts())

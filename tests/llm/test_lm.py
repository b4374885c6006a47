import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.fixtures import documents, empty
from wirelens.llm import attention, lm
from wirelens.llm.common import split_words, words

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_base_scores_equal_brute_force(spark):
    df = documents(spark)
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in df.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, text in rows if not held(i) for w in [*text, None])
    n, v = sum(counts.values()), len(counts)
    got = sorted(lm.score(df, *PATHS).collect(), key=lambda r: r.doc_id)
    rows.sort(key=lambda r: r[0])
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, (i, text) in zip(got, rows, strict=True):
        tokens = [*text, None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def small(n: int = 400, seed: int = 0) -> attention.Model:
    """A model of which most parts are far from their start."""
    rng = np.random.default_rng(seed)
    counts = np.zeros(n)
    counts[rng.choice(n, n // 2, replace=False)] = rng.integers(1, 900, n // 2)
    counts[-1] = 50
    model = attention.Model(attention.Vocabulary.of(counts))
    for name in attention.PARAMETERS:
        x = getattr(model, name)
        x += (rng.standard_normal(x.shape) * 0.2).astype(np.float32)
    return model


def plain(model: attention.Model, rows: np.ndarray) -> list[float]:
    """Log probabilities of a text's rows, position by position and row by row."""
    v, out = model.vocabulary, []
    x = [v.open, *rows[:-1]]
    for i, target in enumerate(rows):
        first = max(0, (i // attention.BLOCK - 1) * attention.BLOCK)
        e = [model.e[x[j]].astype(float) for j in range(first, i + 1)]
        s = np.array([(e[-1] @ model.wq) @ (e[j] @ model.wk) / math.sqrt(attention.KEYS) + model.near[i - first - j] for j in range(len(e))])
        share = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        u = e[-1] + sum(a * (y @ model.wv) for a, y in zip(share, e, strict=True))
        h = u + np.maximum(u @ model.w1 + model.b1, 0) @ model.w2
        c = h @ model.c + model.cb
        total = c[v.cls[target]] - np.log(np.exp(c).sum())
        inside = np.flatnonzero(v.cls == v.cls[target])
        if v.cls[target] == attention.CLASSES - 1:
            total -= math.log(v.unseen)
        else:
            o = model.o[inside] @ h + model.ob[inside]
            total += o[inside == target][0] - np.log(np.exp(o).sum())
        out.append(float(total))
    return out


def test_scores_equal_a_plain_loop():
    model = small()
    v = model.vocabulary
    rng = np.random.default_rng(1)
    texts = [np.append(v.row[rng.integers(0, 399, n)], v.row[-1]) for n in (0, 1, 31, 32, 33, 64, 150)]
    starts = np.cumsum([0, *map(len, texts[:-1])])
    got = model.log_probabilities(np.concatenate(texts), starts)
    assert np.allclose(got, np.concatenate([plain(model, t) for t in texts]), atol=2e-3)


def test_gradients_equal_differences():
    model = small()
    rng = np.random.default_rng(2)
    windows = rng.integers(0, len(model.vocabulary.counts) - 1, (3, 3 * attention.BLOCK + 1))
    windows[0, :20] = windows[1, -9:] = model.vocabulary.none
    _, grads, rows = model.gradients(windows)
    for name in attention.PARAMETERS:
        g, x = grads[name], getattr(model, name)
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        here = (rows[at[0]], *at[1:]) if name == "e" else at
        old, loss = x[here], []
        for step in (0.01, -0.01):
            x[here] = old + step
            loss.append(model.gradients(windows)[0])
        x[here] = old
        assert (loss[0] - loss[1]) / 0.02 == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_probabilities_sum_to_one():
    model = small()
    v = model.vocabulary
    context = v.row[:40]
    last = np.array([np.exp(model.log_probabilities(np.append(context, r), np.array([0]))[-1]) for r in range(len(v.counts))])
    assert last[:-1].sum() + last[-1] * v.unseen == pytest.approx(1, abs=1e-3)


def test_averaged_models_keep_rows_that_none_used():
    model = small()
    v = model.vocabulary
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(2):
        mine = small()
        parts.append(attention.weighed(mine, mine.train(rng.integers(0, 40, (20, 3 * attention.BLOCK + 1)), 0, 1)))
    before = model.e.copy()
    attention.mean(model, [a + b for a, b in zip(*parts, strict=True)])
    assert np.allclose(model.e[60 : v.open], before[60 : v.open]) and not np.allclose(model.e[:40], before[:40]) and np.isfinite(model.o).all()


def test_windows_come_from_all_training_texts(spark):
    texts = ["word " * 30_000, *(f"text number {k} of some length, " * 40 for k in range(60)), "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ids = np.arange(50_257)
    v = attention.Vocabulary(ids.astype(np.int32), np.ones(50_258), 1)
    got = lm.training_windows(df, spark.sparkContext.broadcast(v), *PATHS, spacing=500).collect()
    assert len(got) == pytest.approx(sum(len(t or "") + 1 for t in texts) / 500, rel=0.15)
    rows = [np.frombuffer(r.window, "<u4") for r in got]
    word = lm.word_ids([b"word"], *PATHS)[0][0]
    assert sum((x[40:] == word).any() for x in rows) >= 295  # 150,000 characters: every place of the long text is reached
    ends = [x for x in rows if (x == 50_256).any()]
    assert ends and all(v.open in x or x[0] != v.none for x in rows)


def test_training_beats_word_frequencies_on_held_out_texts(spark):
    rng = np.random.default_rng(0)
    lists = [[f"{a}{b}" for a in x for b in y] for x, y in ((("ka", "lo", "mi", "tu"), ("ren", "sol", "dor")), (("vu", "pe", "ha", "zi"), ("gat", "nim", "bel")))]
    rows = [(i, " ".join(rng.choice(lists[i % 2], 300))) for i in range(400)]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_empty_table_and_tables_without_training_texts(spark):
    assert lm.score(empty(spark), *PATHS).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.score(spark.createDataFrame([(held, "some text")], "doc_id long, text string"), *PATHS).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score) and r.base_score == pytest.approx(0)


def test_words_are_split_alike():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("aB é\x1c\x85\xa0\u2003\n\t\x0b\r"), 30)) for _ in range(300)] + ["", " ", None, " A b "]
    sizes, found = split_words(pa.array(texts))
    assert [w.encode() for w in found.to_pylist()] == [w for t in texts for w in words(t)] and sizes.tolist() == [len(words(t)) for t in texts]


def test_training_predicts_every_subword_of_every_text_once(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["word", "Another", "long-winded", "x"], n)) for n in (1, 40, 63, 64, 65, 700, 3000)] + ["", None]
    v = attention.Vocabulary(np.arange(50_257).astype(np.int32), np.ones(50_258), 1)
    got = lm.training_stretches(spark.createDataFrame([(t,) for t in texts], "text string"), spark.sparkContext.broadcast(v), *PATHS).collect()
    spell = lambda t: [*lm.word_ids(words(t), *PATHS)[0].tolist(), 50_256]
    wanted = [spell(t) for t in texts]
    windows = lm._windows([r.window for r in got])
    assert windows.shape[1] == 3 * attention.BLOCK + 1
    targets = windows[:, attention.BLOCK + 1 :]
    assert Counter(targets[targets != v.none].tolist()) == Counter(i for t in wanted for i in t)
    # Each window stands in a text as it is cut: its context, up to the text's opening, is what comes before its targets.
    padded = Counter()
    for t in wanted:
        x = [v.none] * attention.BLOCK + [v.open, *t] + [v.none] * 64
        padded.update(tuple(x[a : a + 97]) for a in range(0, len(t), 64))
    assert Counter(map(tuple, windows.tolist())) == padded


def test_stretches_take_two_bytes_a_subword_unless_rows_are_too_many(spark):
    """They took four whatever the vocabulary, in the stored stretches and in every round's shuffle."""
    text = "word " * 8 * lm.STRETCH * 2 * attention.BLOCK
    for n, width in ((50_258, 2), (1 << 16, 4)):
        v = attention.Vocabulary(np.arange(50_257).astype(np.int32), np.ones(n), 1)
        got = lm.training_stretches(spark.createDataFrame([(text,)], "text string"), spark.sparkContext.broadcast(v), *PATHS).collect()
        many = len(lm.word_ids(words(text), *PATHS)[0]) + 1
        windows = lm._windows([r.window for r in got], v.stored)
        assert (windows[:, attention.BLOCK + 1 :] != v.none).sum() == many
        assert sum(len(r.window) for r in got) < 1.1 * width * many

"""Language-model scoring: causal self-attention on subword ids, trained by averaged local steps over the corpus, beside a word-frequency base."""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.attention import BLOCK, Model, Vocabulary, mean, weighed
from wirelens.llm.common import batches, by_bytes, least_count, remainder_col, save, split_words
from wirelens.llm.packing import encode, encoders

#: Windows, of 64 predicted subwords each, that a stretch of a training text holds at most.
STRETCH = 16
#: Windows that one task trains on between two averages of the models.
WINDOWS = 16_384
#: Models that one task adds up.
FAN_IN = 16
#: Up to so many of the most frequent words have their counts broadcast; the counts of all others are joined.
HEAD = 1 << 18
#: Different words that a task keeps the spelling of.
MOST_KEPT = 300_000
#: Bytes of texts that are split into words, counted and scored together.
TOGETHER = 2 << 20
#: Characters around a window's first that are cut out: before it for context, behind it for what is predicted.
LEAD, REACH = 200, 600
WORD, SUBWORD, TOTAL = 0, 1, 2
SPACE = re.compile(r"[\x20\x09-\x0D]")


@cache
def _spaced(json_path: str, ranks_path: str | None, vocabulary: int = 1 << 17) -> np.ndarray:
    """Whether a subword begins with a space."""
    spaced = np.zeros(vocabulary, bool)
    names = encoders(json_path, ranks_path)[0].get_vocab()
    spaced[[i for name, i in names.items() if name.startswith("Ġ")]] = True  # the vocabulary file's sign for a space
    return spaced


def word_ids(found: list[bytes], json_path: str, ranks_path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids of words, each behind a space: all ids in order, and each word's number of them.

    A word holds no space, so in a text of words every subword that begins
    with a space begins a word, and many words are encoded at once. Bytes that
    are no UTF-8 are replaced.
    """
    parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    spaced = _spaced(json_path, ranks_path)
    for a in range(0, len(found), 10_000):
        some = found[a : a + 10_000]
        text = " " + b" ".join(some).decode("utf-8", "replace")
        ids = encode(text, json_path, ranks_path, special=False) if text.isprintable() else np.zeros(0, np.uint32)
        starts = np.flatnonzero(spaced[ids])
        if len(starts) == len(some):
            sizes.append(np.diff(np.r_[starts, len(ids)]))
        else:  # some word holds a space of another kind
            each = [encode(" " + w.decode("utf-8", "replace"), json_path, ranks_path, special=False) for w in some]
            ids = np.concatenate(each)
            sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        parts.append(ids)
    return np.concatenate(parts), np.concatenate(sizes)


def _hash(w: bytes) -> int:
    h = xxhash.xxh64_intdigest(w)
    return h - (h >> 63 << 64)


class Speller:
    """Numbers different words in order of first sight, and keeps their subwords; it starts anew when it holds too many."""

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        self.paths = (json_path, ranks_path)
        self.clear()

    def clear(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, found: pa.Array) -> np.ndarray:
        known = found.dictionary_encode()
        number = np.fromiter(map(self.number.__getitem__, known.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(known.dictionary))
        return number[known.indices.to_numpy(zero_copy_only=False)]

    def learn(self) -> list[bytes]:
        """Spell the words numbered since the last call; gives these words."""
        new = list(islice(self.number, len(self.size), None))
        if new:
            ids, sizes = word_ids(new, *self.paths)
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(sizes) - sizes]
            self.size, self.flat = np.r_[self.size, sizes], np.r_[self.flat, ids.astype(np.int64)]
        return new

    def spelt(self, numbers: np.ndarray) -> np.ndarray:
        """Subword ids of words, by their numbers, in order."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[numbers] - ends + sizes, sizes)]


def corpus_counts(texts: DataFrame, json_path: str, ranks_path: str | None, vocabulary: int) -> DataFrame:
    """(kind, h, n): training counts of every word by its hash, of every subword by its id, and of words and of texts in all (``TOTAL``: 0 and 1)."""
    schema = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def rows(kind: int, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(h), 100_000):
            z = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[z]), kind, np.int32)), pa.array(h[z].astype(np.int64)), pa.array(n[z].astype(np.int64))], schema=schema)

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, total, held = np.zeros(vocabulary, np.int64), np.zeros(2, np.int64), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(held)
            n = np.fromiter(held.values(), np.int64, len(found))
            for a in range(0, len(found), 50_000):
                ids, sizes = word_ids(found[a : a + 50_000], json_path, ranks_path)
                subwords[:] += np.bincount(ids.astype(np.int64), np.repeat(n[a : a + 50_000], sizes), vocabulary).astype(np.int64)
            held.clear()
            yield from rows(WORD, np.fromiter(map(_hash, found), np.int64, len(found)), n)

        for part in (x for part in parts for x in by_bytes(part, "text", 4 * TOGETHER)):
            sizes, found = split_words(part.column("text"))
            total += (sizes.sum(), len(sizes))
            values, times = found.value_counts().flatten()
            for w, n in zip(values.cast(pa.binary()).to_numpy(zero_copy_only=False), times.to_pylist(), strict=True):
                held[w] += n
            if len(held) > MOST_KEPT:
                yield from flush()
        yield from flush()
        seen = np.flatnonzero(subwords)
        yield from rows(SUBWORD, seen, subwords[seen])
        yield from rows(TOTAL, np.arange(2), total)

    return texts.select("text").mapInArrow(tally, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


def head_counts(counts: DataFrame, most: int = HEAD) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count of the head, and the hashes and counts of its words, by hash: all words from that count on, ``most`` of them or fewer.

    The driver sees a histogram, then the head.
    """
    least = least_count(counts.where(F.col("kind") == WORD), most)
    found = counts.where((F.col("kind") == WORD) & (F.col("n") >= least)).select("h", "n").toArrow().sort_by("h")
    return least, found.column("h").to_numpy(), found.column("n").to_numpy()


def training_windows(texts: DataFrame, shared_vocabulary, json_path: str, ranks_path: str | None, spacing: int) -> DataFrame:
    """(u, window): a sample of windows of every training text, ``spacing`` characters apart from an offset by the text's hash, for quick trials; u shuffles them. ``score`` learns from ``training_stretches``, which leave out nothing.

    A window that begins near a text's start begins at its start; one that
    reaches the text's end predicts the end. Long texts give as many more. A
    window holds 32 rows of context, 64 that are predicted and the row before
    the first of those.
    """
    schema = pa.schema([("u", pa.int64()), ("window", pa.binary())])

    def cut(text: str) -> Iterator[tuple[str | None, str, bool, int]]:
        """A window's context (none at a text's start) and what follows, whether that reaches the end, and the place."""
        for at in range(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) % spacing, len(text) + 1, spacing):
            start, before = 0, None
            if at >= LEAD:
                m = SPACE.search(text, at, at + REACH)
                start = m.end() if m else at
                m = SPACE.search(text, start - LEAD, start)
                before = text[m.end() if m else start - LEAD : start]
            stop = start + REACH
            if stop < len(text):
                stop = max(text.rfind(" ", start, stop), text.rfind("\n", start, stop), start)
                stop = stop if stop > start else start + REACH
            yield before, text[start:stop], stop >= len(text), at

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_vocabulary.value
        speller = Speller(json_path, ranks_path)

        def made() -> Iterator[tuple]:
            for part in (x for part in parts for x in by_bytes(part, "text", TOGETHER)):
                if len(speller.number) > MOST_KEPT:
                    speller.clear()
                found = [x for t in part.column("text") for x in cut(t.as_py() or "")]
                sizes, cut_words = split_words(pa.array([x for before, after, _, _ in found for x in (before, after)], pa.string()))
                numbers, ends = speller.numbers(cut_words), np.cumsum(sizes)
                speller.learn()
                for k, (before, _, last, at) in enumerate(found):
                    middle = ends[2 * k]
                    context = v.row[speller.spelt(numbers[middle - sizes[2 * k] : middle])][-BLOCK - 1 :]
                    if before is None or not len(context):
                        context = np.array([v.open], np.int32)
                    next_ = v.row[speller.spelt(numbers[middle : ends[2 * k + 1]])]
                    next_ = (np.append(next_, v.row[-1]) if last else next_)[: 2 * BLOCK]
                    window = np.full(3 * BLOCK + 1, v.none, np.int32)
                    window[BLOCK + 1 - len(context) : BLOCK + 1] = context
                    window[BLOCK + 1 : BLOCK + 1 + len(next_)] = next_
                    data = window.astype("<u4").tobytes()
                    yield xxhash.xxh64_intdigest(data, at) >> 2, data

        yield from batches(made(), schema, weight=1)

    return texts.select("text").mapInArrow(run, "u long, window binary")


def training_stretches(texts: DataFrame, shared_vocabulary, json_path: str, ranks_path: str | None) -> DataFrame:
    """(u, window): every training text whole, in stretches in which each of its subwords, and its end, is predicted once; u shuffles them.

    A stretch holds 32 rows of context, the row before the first that is
    predicted, and then up to ``STRETCH`` times 64 rows that are, each 64 of
    which are a window (see ``_windows``). A text's first stretch opens it; its
    last is filled up with rows that stand for nothing.
    """
    schema = pa.schema([("u", pa.int64()), ("window", pa.binary())])
    step, lead = 2 * BLOCK, BLOCK + 1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_vocabulary.value
        speller = Speller(json_path, ranks_path)

        def made() -> Iterator[tuple]:
            for part in (x for part in parts for x in by_bytes(part, "text", TOGETHER)):
                if len(speller.number) > MOST_KEPT:
                    speller.clear()
                sizes, found = split_words(part.column("text"))
                numbers, ends = speller.numbers(found), np.cumsum(sizes)
                speller.learn()
                for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
                    own = v.row[speller.spelt(numbers[end - size : end])]
                    rows = np.full(lead + -(-(len(own) + 1) // step) * step, v.none, v.stored)
                    rows[BLOCK], rows[lead : lead + len(own)], rows[lead + len(own)] = v.open, own, v.row[-1]
                    for at in range(0, len(rows) - lead, STRETCH * step):
                        data = rows[at : at + lead + STRETCH * step].tobytes()
                        yield xxhash.xxh64_intdigest(data, at) >> 2, data

        yield from batches(made(), schema, weight=1)

    return texts.select("text").mapInArrow(run, "u long, window binary")


def _windows(stretches: list[bytes], stored: np.dtype | str = "<u2") -> np.ndarray:
    """The windows of stretches, one a row: a block of context, the row before, two blocks that are predicted."""
    step, width = 2 * BLOCK, 3 * BLOCK + 1
    rows = [np.frombuffer(x, stored) for x in stretches]
    return np.concatenate([np.lib.stride_tricks.sliding_window_view(x, width)[::step] for x in rows]).astype(np.int64)


def _pickled(rows: Iterator[object]) -> Iterator[pa.RecordBatch]:
    return batches(((pickle.dumps(x),) for x in rows), pa.schema([("state", pa.binary())]), weight=0)


def trained(stretches: DataFrame, model: Model, per_task: int = WINDOWS) -> Model:
    """Train on all windows of all stretches, in rounds: each has twice the tasks of the one before it, and each task trains a copy of the model on windows of its own.

    After a round the copies are averaged by a tree of sums, so no task holds
    more than a few copies and the driver gets one. Rounds grow with the
    logarithm of the number of windows.
    """
    sc, stored = stretches.sparkSession.sparkContext, model.vocabulary.stored
    of_one = F.floor((F.length("window") / stored.itemsize - BLOCK - 1) / (2 * BLOCK))
    total, done, tasks = stretches.agg(F.coalesce(F.sum(of_one), F.lit(0)).cast("long")).first()[0], 0, 1

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for part in parts:
            for state in part.column(0):
                new = pickle.loads(state.as_py())
                sums = new if sums is None else [a + b for a, b in zip(sums, new, strict=True)]
        if sums is not None:
            yield from _pickled(iter([sums]))

    while done < total:
        own = min(total - done, tasks * per_task)
        tasks = -(-own // per_task)
        shared, begun, share = sc.broadcast(model), done / total, own / total

        def train(parts: Iterator[pa.RecordBatch], shared=shared, begun=begun, share=share) -> Iterator[pa.RecordBatch]:
            mine = pickle.loads(pickle.dumps(shared.value))
            found = sorted((u, data) for part in parts for u, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            if found:
                rows = _windows([data for _, data in found], stored)
                # Neighbours in a text come apart; the order is that of the first stretch's hash, so reruns agree.
                np.random.default_rng(found[0][0]).shuffle(rows)
                yield from _pickled(iter([weighed(mine, mine.train(rows, begun, share))]))

        low, high = (int(x / total * (1 << 62)) for x in (done, done + own))
        states = stretches.where((F.col("u") >= low) & (F.col("u") < max(high, low + 1))).repartition(tasks).mapInArrow(train, "state binary")
        n = tasks
        while n > 1:
            n = -(-n // FAN_IN)
            states = states.repartition(n).mapInArrow(add, "state binary")
        found = states.first()
        if found is not None:
            mean(model, pickle.loads(found[0]))
        shared.destroy()
        done, tasks = done + own, 2 * tasks
    return model


def score(docs: DataFrame, json_path: str, ranks_path: str | None = None, vocabulary: int = 50_256, held_out: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are a text's words, A-Z lower-cased, and one end; null and empty
    texts have the end alone. The base sums log10((c + 1) / (N + V + 1)) over
    tokens, c being a token's count in all training texts, N their tokens, V
    their different tokens. ``score`` is the log10 probability of the text by
    attention over its subwords, each word behind a space, and its end; blocks
    overlap with those before them and every subword is scored once.
    Subwords are counted in all training texts, and attention is trained to
    predict every subword and end of theirs once. Repeated rows each give a row, and rows with a null id are training
    or held out by the crc of the empty text. An empty table gives an empty
    result; other columns are ignored.
    """
    rem, left = held_out
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("held", remainder_col(F.col("doc_id"), rem) == left)
    texts = rows.where("not held")
    counts = save(corpus_counts(texts, json_path, ranks_path, vocabulary))
    least, head, head_n = head_counts(counts)
    small = {(r["kind"], r["h"]): r["n"] for r in counts.where(F.col("kind") != WORD).collect()}  # a row a subword of the tokenizer at most
    n_words, n_texts = small.get((TOTAL, 0), 0), small.get((TOTAL, 1), 0)
    by_id = np.zeros(vocabulary + 1)
    for (kind, h), n in small.items():
        if kind == SUBWORD:
            by_id[h] = n
    by_id[vocabulary] = n_texts
    different = counts.where(F.col("kind") == WORD).count() + (1 if n_texts else 0)
    v = Vocabulary.of(by_id)
    sc = rows.sparkSession.sparkContext
    shared_v = sc.broadcast(v)
    model = trained(save(training_stretches(texts, shared_v, json_path, ranks_path)), Model(v))
    judged = save(_judged(rows, sc.broadcast((model, head, np.log10(head_n + 1.0))), json_path, ranks_path))
    rest = judged.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("rid", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    known = counts.where((F.col("kind") == WORD) & (F.col("n") < least)).select("h", "n")
    found = rest.join(known, "h").groupBy("rid").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
    n_tokens = F.col("n_words") + 1
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(float(np.log10(n_texts + 1)))
    return judged.drop("rare", "times").join(found, "rid", "left").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("held").alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if n_texts else 0)).alias("n_known"), F.lit(n_words + n_texts).cast("long").alias("train_tokens"),
        (logs - n_tokens * F.lit(float(np.log10(n_words + n_texts + different + 1)))).alias("base_score"), "score",
    )


def _judged(rows: DataFrame, shared, json_path: str, ranks_path: str | None) -> DataFrame:
    """Rows with a number (rid), the score, and the base's share of frequent words; other words by hash and times, to be joined."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held", pa.bool_()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
    ])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head, head_logs = shared.value
        v = model.vocabulary
        speller = Speller(json_path, ranks_path)
        hashes, logs, common = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)

        def learn() -> None:
            nonlocal hashes, logs, common
            if new := speller.learn():
                h = np.fromiter(map(_hash, new), np.int64, len(new))
                at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                hit = head[at] == h if len(head) else np.zeros(len(h), bool)
                hashes, common, logs = np.r_[hashes, h], np.r_[common, hit], np.r_[logs, np.where(hit, head_logs[at], 0) if len(head) else np.zeros(len(h))]

        for whole in parts:
            for part in by_bytes(whole, "text", TOGETHER):
                if len(speller.number) > MOST_KEPT:
                    speller.clear()
                    hashes, logs, common = hashes[:0], logs[:0], common[:0]
                n_words, found = split_words(part.column("text"))
                numbers = speller.numbers(found)
                learn()
                # The texts' subwords, each text's end behind its own.
                last = np.cumsum(n_words)
                before = np.r_[0, np.cumsum(speller.size[numbers])]
                starts = before[last - n_words] + np.arange(len(last))
                rows = np.insert(v.row[speller.spelt(numbers)], before[last], v.row[-1])
                scores = np.add.reduceat(model.log_probabilities(rows, starts).astype(np.float64), starts) / np.log(10)
                of, frequent = np.repeat(np.arange(len(last)), n_words), common[numbers]
                total = lambda x, of=of, n=len(last): np.bincount(of, x, n)
                rare, times = np.unique(of[~frequent] * len(hashes) + numbers[~frequent], return_counts=True)
                offsets = np.searchsorted(rare, np.arange(len(last) + 1) * max(1, len(hashes))).astype(np.int32)
                lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[rare % max(1, len(hashes))], times.astype(np.int32)))
                numbers_of = (n_words.astype(np.int64), total(frequent).astype(np.int64), total(logs[numbers]), scores)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held"), *map(pa.array, numbers_of), *lists], schema=schema)

    names = "doc_id long, held boolean, n_words long, n_known long, logs double, score double, rare array<long>, times array<int>"
    return rows.select("doc_id", "text", "held").mapInArrow(run, names).withColumn("rid", F.monotonically_increasing_id())

"""Toxicity by a support vector machine over a gap-tolerant string kernel with Nyström landmarks."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.common import batches, remainder_col

#: The kernel counts common subsequences of three symbols; these are their steps, each skipped symbol costs the decay.
STEPS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1))
DECAY = 0.6
SYMBOLS, START, END, OTHER = 48, 28, 29, 30
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SENTENCE = re.compile(r"[.!?\n]+\s")
#: Bounds of the labelled sample that the machine is fitted on, and of its fitting.
TOXIC_ROWS, CLEAN_ROWS = 3000, 4000
LANDMARKS, ROUNDS, NEGATIVES = 448, 4, 10_000
#: A string is a witness by its counts alone from this log likelihood ratio, and this many times as frequent in toxic texts.
SURE, RATIO = 10.0, 20
MOST_HELD = 300_000


@cache
def _table() -> np.ndarray:
    """Symbol of every code point; 0 is left out."""
    table = np.zeros(0x110000, np.int32)
    far = np.arange(0x250, 0x110000)
    table[0x250:] = OTHER + far % (SYMBOLS - OTHER)
    table[0x2000:0x2070] = 0  # punctuation
    for cp in range(0x250):
        ch = chr(cp).lower()
        ch = LEET.get(ch, ch)
        if ch.isascii() and ch.isalpha():
            table[cp] = ord(ch[0]) - 96
        elif ch.isdigit():
            table[cp] = 27
        elif ch.isalpha():
            table[cp] = OTHER + ord(ch[0]) % (SYMBOLS - OTHER)
    table[2], table[3] = START, END
    return table


def triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of strings: row, triple, weight; each row has about unit length.

    A string becomes symbols between a start and an end mark: letters,
    look-alike digits as letters; marks inside it are left out.
    """
    text = "".join(f"\x02{s}\x03" for s in strings)
    flat = _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    flat = flat[flat > 0]
    same = flat[1:] == flat[:-1]
    flat = np.delete(flat, np.flatnonzero(same[1:] & same[:-1]) + 2)  # a symbol more than twice in a row counts as twice
    own = np.cumsum(flat == START) - 1
    rows, codes, values = [], [], []
    for g, h in STEPS:
        span = g + h
        if len(flat) <= span:
            continue
        inside = own[:-span] == own[span:]
        code = (flat[:-span] * SYMBOLS + flat[g : len(flat) - h]) * SYMBOLS + flat[span:]
        rows.append(own[:-span][inside])
        codes.append(code[inside])
        values.append(np.full(len(rows[-1]), DECAY ** (span - 2), np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
    row, code, value = map(np.concatenate, (rows, codes, values))
    length = np.sqrt(np.bincount(row, value.astype(np.float64) ** 2, len(strings)))
    return row, code, (value / length[row]).astype(np.float32)


def strings(text: str) -> list[str]:
    """The words, and runs of three or more single characters joined."""
    found = text.split()
    lone = np.fromiter(map(len, found), np.int32, len(found)) == 1
    if lone.sum() >= 3:
        edges = np.flatnonzero(np.diff(np.r_[False, lone, False]))
        found += ["".join(found[a:b]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= 3]
    return found


@dataclass
class Machine:
    """A linear function of kernel features, the machine's weights summed over its landmarks, and a logistic function of a text's highest margins."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray | None = None

    def margins(self, found: list[str], step: int = 20_000) -> np.ndarray:
        out = [np.full(0, self.bias)]
        for a in range(0, len(found), step):
            part = found[a : a + step]
            row, code, value = triples(part)
            out.append(np.bincount(row, self.weights[code] * value, len(part)) + self.bias)
        return np.concatenate(out)

    def probability(self, margins: np.ndarray) -> float:
        """Of a text with these margins of its strings; of the bias alone if it has none."""
        return float(1 / (1 + np.exp(-np.clip(self.features(margins) @ self.logistic, -60, 60))))

    def features(self, margins: np.ndarray) -> np.ndarray:
        """The three highest margins, the log of the number of strings, and 1."""
        top = np.full(3, self.bias)
        if len(margins):
            best = np.sort(np.partition(margins, -min(3, len(margins)))[-3:])[::-1]
            top[: len(best)] = best
        return np.array([*top, np.log1p(len(margins)), 1.0])


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 15, block: int = 2048) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton's method."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        left, right = np.eye(len(w)), np.zeros(len(w))
        for s in range(0, len(x), block):
            a = np.c_[x[s : s + block], np.ones(len(x[s : s + block]))].astype(np.float64)
            c = cost[s : s + block] * (y[s : s + block] * (a @ w) < 1)
            left += (a.T * c) @ a
            right += a.T @ (c * y[s : s + block])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _features(found: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of strings restricted to the sorted triples ``codes``: row, place in codes, weight, in order of rows."""
    row, code, value = triples(found)
    place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    own = codes[place] == code
    row, place, value = row[own], place[own], value[own]
    order = np.argsort(row, kind="stable")
    return row[order], place[order], value[order]


def _kernel(found: list[str], phi: np.ndarray, codes: np.ndarray) -> np.ndarray:
    row, place, value = _features(found, codes)
    at = np.searchsorted(row, np.arange(len(found) + 1))
    k = np.zeros((len(found), len(phi)), np.float32)
    for i in range(len(found)):
        k[i] = phi[:, place[at[i] : at[i + 1]]] @ value[at[i] : at[i + 1]]
    return k


def _landmarks(candidates: list[str], most: int, apart: float = 0.75) -> list[str]:
    """The first candidates of which none is too like another."""
    chosen: list[str] = []
    codes = np.unique(triples(candidates)[1])
    dense = np.zeros((min(most, len(candidates)), len(codes)), np.float32)
    row, place, value = _features(candidates, codes)
    at = np.searchsorted(row, np.arange(len(candidates) + 1))
    for i, u in enumerate(candidates):
        if len(chosen) == most:
            break
        p, v = place[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
        if len(p) and (not chosen or (dense[: len(chosen)][:, p] @ v).max() < apart):
            np.add.at(dense[len(chosen)], p, v)
            chosen.append(u)
    return chosen


def _machine(positive: list[str], negative: list[str], cost: np.ndarray, landmarks: list[str]) -> Machine:
    codes = np.unique(triples(landmarks)[1])
    row, place, value = _features(landmarks, codes)
    phi = np.zeros((len(landmarks), len(codes)), np.float32)
    np.add.at(phi, (row, place), value)
    e, v = np.linalg.eigh((phi @ phi.T).astype(np.float64))
    root = (v / np.sqrt(np.maximum(e, 1e-3))) @ v.T
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    w = svm(_kernel(positive + negative, phi, codes) @ root.astype(np.float32), y, cost)
    weights = np.zeros(SYMBOLS**3, np.float32)
    weights[codes] = (root @ w[:-1]) @ phi
    return Machine(weights, float(w[-1]))


def fit(sample: Iterable[tuple[str | None, int]]) -> Machine:
    """Learn from (text, label) rows.

    A text's label holds for its sentences as bags of strings: every string of
    a clean sentence is clean, and a toxic one may have a witness. Witnesses
    are strings that toxic sentences have far more often; the clean strings
    that the machine likes most are added as counter-examples, round by round.
    With one label only, the result is that label's share.
    """
    # Every third row, in a repeatable order, is kept from the machine, for the logistic function.
    rows = sorted(((text or "", int(label)) for text, label in sample), key=lambda r: (r[1], zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r[0]))
    sample, bags = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    share = sum(label for _, label in rows) / max(1, len(rows))
    if len({label for _, label in sample}) < 2:
        return _constant(share)
    # Sentences count once, however many copies of a text there are; one that clean texts have is clean.
    df, n, said = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}, set()
    for text, label in sample:  # clean texts first
        for sentence in SENTENCE.split(text.lower()):
            if (name := xxhash.xxh64_intdigest(sentence.encode("utf-8", "surrogatepass"))) not in said:
                said.add(name)
                n[label] += 1
                df[label].update(set(map(_key, strings(sentence))))
    n[1] = max(1, n[1])
    clean = sorted(df[0], key=lambda u: (-df[0][u], u))
    telling = {u for u, c in df[1].items() if c * n[0] >= RATIO * df[0][u] * n[1] and _tells(c, df[0][u], n[1], n[0]) >= SURE}
    hard = sorted({*clean[: NEGATIVES // 2], *clean[:: max(1, len(clean) // (NEGATIVES // 2))]} - telling)
    machine, likes = None, []
    count = Counter({u: df[1][u] for u in telling})
    for _ in range(ROUNDS):
        positive = [u for u, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:NEGATIVES]]
        if not positive:
            break
        cost = np.r_[[10 * (1 + np.log(count[u])) for u in positive], [1 + np.log(df[0][u]) for u in hard]]
        marks = _landmarks(positive, LANDMARKS // 2)
        others = sorted(hard, key=lambda u, near=frozenset(likes[:500]): (u not in near, -df[0][u], u))[: 8 * LANDMARKS]
        marks += _landmarks(others, LANDMARKS - len(marks))
        machine = _machine(positive, hard, cost, marks)
        likes = [clean[i] for i in np.argsort(-machine.margins(clean), kind="stable")[: NEGATIVES // 4]]
        hard = sorted({*hard, *likes} - telling)
    if machine is None:  # no string tells the labels apart
        return _constant(share)
    x = []
    for text, _ in bags:
        found = strings(text)
        unlike = list(set(found))
        held = dict(zip(unlike, machine.margins(unlike).tolist(), strict=True))
        x.append(machine.features(np.array([held[u] for u in found])))
    machine.logistic = logistic(np.array(x), np.array([label for _, label in bags]))
    return machine


def _constant(share: float) -> Machine:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Machine(np.zeros(SYMBOLS**3, np.float32), 0.0, np.array([0.0, 0.0, 0.0, 0.0, np.log(p / (1 - p))]))


def _tells(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log likelihood ratio of a string's counts for its being more frequent in toxic texts; 0 if it is not."""
    if toxic * n_clean <= clean * n_toxic:
        return 0.0
    p = (toxic + clean) / (n_toxic + n_clean)
    side = lambda k, m, q: k * np.log(q) + (m - k) * np.log1p(-q)
    own, other = min(toxic / n_toxic, 1 - 1e-9), min(max(clean / n_clean, 1e-9), 1 - 1e-9)
    return float(side(toxic, n_toxic, own) + side(clean, n_clean, other) - side(toxic, n_toxic, p) - side(clean, n_clean, p)) if p < 1 else 0.0


def _key(u: str) -> str:
    return u.strip(".,;:!?|()[]{}\"'")


def logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a ridge-bound logistic regression with smoothed targets, by damped Newton steps."""
    up, down = labels.sum(), (1 - labels).sum()
    t = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.1), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (p - t) + ridge * w)
        w = w - np.clip(step, -2, 2)
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(text, label) of a bounded, repeatable sample of labelled rows outside the held-out remainder: ``toxic_rows`` and ``clean_rows`` of them at most, whole texts."""
    of = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").groupBy("_id").agg(F.max("_label").alias("_label"))
    of = of.where(remainder_col(F.col("_id"), held_out[0]) != held_out[1])
    # Twice the rows are drawn, as some have no text.
    some = [of.where(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(2 * n) for y, n in ((1, toxic_rows), (0, clean_rows))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null")
    rows = rows.join(F.broadcast(some[0].union(some[1])), "_id")
    order = [F.xxhash64("_id"), F.col("_id"), F.xxhash64("_text")]
    return rows.where("_label = 1").orderBy(*order).limit(toxic_rows).union(rows.where("_label = 0").orderBy(*order).limit(clean_rows)).select("_text", "_label")


def fitted(sample: DataFrame) -> Machine:
    """Fit on an executor; the sample is bounded, so one task holds it. The driver gets the weights, which have a fixed size."""
    schema = pa.schema([("machine", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = fit(row for part in parts for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        yield from batches([(pickle.dumps(machine),)], schema)

    made = sample.coalesce(1).mapInArrow(run, "machine binary").first()  # none if no task ran, as for an empty table
    return pickle.loads(made[0]) if made else fit(())


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted, and the string that told most (``reason``) of every row; only the text counts.

    A text is judged by its three highest strings and its length in strings.
    Empty and null texts have no string and get the score of the machine's
    bias. Whole texts are read, long ones too.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("reason", pa.string())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part, found in judged(parts, machine, 1):
            for i, (p, best) in zip(part.column(0).to_pylist(), found, strict=True):
                yield i, p, int(p >= threshold), best

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(rows(parts), schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, reason string")


def judged(parts: Iterator[pa.RecordBatch], machine: Machine, column: int | str) -> Iterator[tuple[pa.RecordBatch, list[tuple[float, str | None]]]]:
    """Parts of the batches, with the probability and the highest string of each row's text. Margins of strings are held, within a bound."""
    held: dict[str, float] = {}
    for whole in parts:
        for a in range(0, whole.num_rows, 1000):
            part = whole.slice(a, 1000)
            texts = [strings(t or "") for t in part.column(column).to_pylist()]
            new = [u for u in {u for t in texts for u in t} if u not in held]
            if len(held) + len(new) > MOST_HELD:
                held, new = {}, list({u for t in texts for u in t})
            held |= zip(new, machine.margins(new).tolist(), strict=True)
            out = []
            for found in texts:
                margins = np.fromiter(map(held.__getitem__, found), np.float64, len(found))
                out.append((machine.probability(margins), found[int(margins.argmax())] if len(found) else None))
            yield part, out


def toxicity(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted, reason; fitted on ``labels`` outside the held-out remainder.

    The fit takes ``toxic_rows`` and ``clean_rows`` labelled rows at most;
    every row is scored. Null and empty texts have the bias's score; repeated
    rows each give a row, and an id's labels are joined to all its rows; an
    empty table gives an empty result; other columns are ignored.
    """
    found = score(docs, fitted(labelled_sample(docs, labels, held_out, id_col, text_col, toxic_rows=toxic_rows, clean_rows=clean_rows)), threshold, id_col, text_col)
    return found.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), (remainder_col(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "score", "predicted", "reason")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns; the verdict travels with its row, so repeated ids are no trouble.

    Null and empty texts have no toxic string and stay; rows repeated whole
    are judged each; an empty table gives an empty result.
    """
    machine = fitted(labelled_sample(docs, labels, id_col=id_col, text_col=text_col))

    def clean(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in judged(parts, machine, text_col):
            yield part.filter(pa.array([p < threshold for p, _ in found], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

"""A causal self-attention model of subword rows in numpy: its layers, its training step and its scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Positions of a block; each position sees its own block up to itself and the block before it.
BLOCK = 32
#: Sizes of keys, states and the hidden layer; number of classes of the output layer.
KEYS, WIDTH, HIDDEN, CLASSES = 8, 32, 16, 24
#: Windows a training step takes, and the step's first rate.
BATCH, RATE = 64, 0.1
#: Positions that attention takes together, few, so that they stay in a core's cache; and that the output layer takes together.
ATTEND, AT_ONCE = 4096, 32768
PARAMETERS = ("e", "wk", "wv", "wq", "near", "w1", "b1", "w2", "c", "cb", "o", "ob")
_MASK = np.where(np.tri(BLOCK, 2 * BLOCK, BLOCK, dtype=bool), 0, -1e4).astype(np.float32)
_DISTANCE = (np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)).clip(0)


@dataclass
class Vocabulary:
    """Rows of the subwords that training texts hold, most frequent first; one more row stands for all others.

    ``OPEN`` opens a text and ``NONE`` stands for no token; both follow the
    other rows and are inputs alone. A class of the output layer is a range of
    rows with about as much of the root of the counts as any other.
    """

    row: np.ndarray  # of every subword id, and of the end, last
    counts: np.ndarray  # of every output row
    unseen: int  # ids that share the last output row
    edges: np.ndarray = field(init=False)  # where classes begin, in rows
    cls: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.counts)
        root = np.cumsum(np.sqrt(self.counts[:-1]))
        share = np.minimum((root / max(root[-1] if n > 1 else 1, 1e-9) * (CLASSES - 1)).astype(int), CLASSES - 2)
        self.cls = np.append(share, CLASSES - 1).astype(np.int32)
        self.edges = np.searchsorted(self.cls, np.arange(CLASSES + 1))

    @classmethod
    def of(cls, counts: np.ndarray) -> Vocabulary:
        """From the counts of all ids in the training texts."""
        order = np.argsort(-counts, kind="stable")
        seen = int((counts > 0).sum())
        row = np.full(len(counts), seen, np.int32)
        row[order[:seen]] = np.arange(seen)
        return cls(row, np.append(counts[order[:seen]], 0.0), len(counts) - seen)

    @property
    def open(self) -> int:
        return len(self.counts)

    @property
    def none(self) -> int:
        return len(self.counts) + 1

    @property
    def stored(self) -> np.dtype:
        """What rows are stored as: two bytes each, unless there are too many of them."""
        return np.dtype("<u2" if self.none < 1 << 16 else "<u4")


class Model:
    """Embedded rows; one attention layer with keys, values and queries of them and a bias by distance; a residual layer; classes, and rows within a class."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        near = lambda size, *shape: (rng.standard_normal(shape) * size).astype(np.float32)
        n = len(vocabulary.counts)
        self.vocabulary = vocabulary
        self.e, self.wk, self.wq, self.wv = near(0.1, n + 2, WIDTH), near(0.3, WIDTH, KEYS), near(0.3, WIDTH, KEYS), near(0.2, WIDTH, WIDTH)
        self.near = np.zeros(2 * BLOCK, np.float32)
        self.w1, self.b1, self.w2 = near(0.2, WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), near(0.1, HIDDEN, WIDTH)
        # The output starts at the subwords' shares of the training texts.
        per = np.bincount(vocabulary.cls, vocabulary.counts + 0.5, CLASSES)
        self.c, self.cb = near(0.1, WIDTH, CLASSES), np.log(np.maximum(per, 1e-9) / per.sum()).astype(np.float32)
        self.o, self.ob = near(0.05, n, WIDTH), np.log((vocabulary.counts + 0.5) / per[vocabulary.cls]).astype(np.float32)
        self.squares = {name: np.full_like(getattr(self, name), 1e-7) for name in PARAMETERS}

    def state(self) -> list[np.ndarray]:
        return [x for name in PARAMETERS for x in (getattr(self, name), self.squares[name])]

    def put(self, state: list[np.ndarray]) -> None:
        for k, name in enumerate(PARAMETERS):
            setattr(self, name, state[2 * k].astype(np.float32))
            self.squares[name] = state[2 * k + 1].astype(np.float32)

    def log_probabilities(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability of every row, once; texts begin at ``starts`` and each ends with the end's row."""
        v = self.vocabulary
        sizes = np.diff(np.r_[starts, len(rows)])
        blocks = -(-sizes // BLOCK) + 1  # a block of nothing opens every text
        first = np.cumsum(blocks) - blocks
        place = np.arange(len(rows)) + np.repeat((first + 1) * BLOCK - starts, sizes)
        x = np.full(blocks.sum() * BLOCK, v.none, np.int32)
        inner = np.ones(len(rows), bool)
        inner[np.r_[starts[1:], len(rows)] - 1] = False
        x[place[inner] + 1] = rows[inner]
        x[(first + 1) * BLOCK] = v.open
        x = x.reshape(-1, BLOCK)
        # What a row gives to attention: its key, value, query and state.
        keys, values, queries = (np.ascontiguousarray(self.e @ w) for w in (self.wk, self.wv, self.wq * np.float32(KEYS**-0.5)))
        queries *= np.float32(min(1, 60 / max(1e-9, np.linalg.norm(keys, axis=1).max() * np.linalg.norm(queries, axis=1).max())))  # exp can't overflow
        bias, one = _MASK + self.near[_DISTANCE], np.ones(2 * BLOCK, np.float32)
        out, states, filled, done, step = np.empty(len(rows), np.float32), np.empty((AT_ONCE + ATTEND, WIDTH), np.float32), 0, 0, ATTEND // BLOCK
        ends = np.searchsorted(place, np.arange(1 + step, len(x) + step, step) * BLOCK).tolist()
        for a, end in zip(range(1, len(x), step), ends, strict=True):
            part = x[a - 1 : a + step]
            s = np.take(queries, part[1:], axis=0) @ _pairs(np.take(keys, part, axis=0)).transpose(0, 2, 1)
            s += bias
            s[part[:-1, 0] == v.none, :, :BLOCK] = -1e4  # nothing stands before a text's first block
            np.exp(s, out=s)
            u = (s @ _pairs(np.take(values, part, axis=0))).reshape(-1, WIDTH)
            u /= (s @ one).reshape(-1, 1)
            u += np.take(self.e, part[1:].ravel(), axis=0)
            first = done + filled
            np.take(u, place[first:end] - a * BLOCK, axis=0, out=states[filled : filled + end - first], mode="clip")
            filled = end - done
            if filled >= AT_ONCE or end == len(rows):
                out[done:end] = self._next(states[:filled], rows[done:end])
                done, filled = end, 0
        return out

    def _next(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Log probabilities of rows, given the states of attention before them."""
        v, at = self.vocabulary, np.arange(len(rows))
        g = h @ self.w1
        g += self.b1
        h += np.maximum(g, 0, out=g) @ self.w2
        cls = v.cls[rows]
        logits = h @ self.c
        logits += self.cb
        out = logits[at, cls]
        out -= np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, np.float32))
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        h, inside = np.take(h, order, axis=0), rows[order]
        within = np.zeros(len(rows), np.float32)
        for j in range(CLASSES - 1):
            a, z, lo, hi = ends[j], ends[j + 1], v.edges[j], v.edges[j + 1]
            if a < z and hi - lo > 1:
                g = h[a:z] @ self.o[lo:hi].T
                g += self.ob[lo:hi]
                within[a:z] = g[at[: z - a], inside[a:z] - lo]
                within[a:z] -= np.log(np.exp(g, out=g) @ np.ones(hi - lo, np.float32))
        within[ends[-2] :] -= np.float32(np.log(max(1, v.unseen)))
        out[order] += within
        return out

    def gradients(self, windows: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss of windows, gradients, and the rows of ``e`` that its gradient is of.

        A window has a block of context, two blocks that are predicted from
        what stands before each position, and one row more.
        """
        v, n = self.vocabulary, len(windows)
        x, y = windows[:, : 3 * BLOCK], windows[:, BLOCK + 1 :]
        rows, inv = np.unique(x, return_inverse=True)
        inv = inv.reshape(x.shape)
        e, w = self.e[rows], np.concatenate([self.wk, self.wv, self.wq * np.float32(KEYS**-0.5)], 1)
        t = np.take(e @ w, inv, axis=0).reshape(n, 3, BLOCK, -1)
        pairs = lambda a: np.stack([a[:, :2], a[:, 1:]], 1).reshape(2 * n, 2 * BLOCK, -1)
        k, val, q = pairs(t[..., :KEYS]), pairs(t[..., KEYS : KEYS + WIDTH]), t[:, 1:, :, KEYS + WIDTH :].reshape(2 * n, BLOCK, KEYS)
        s = q @ k.transpose(0, 2, 1)
        s += _MASK + self.near[_DISTANCE]
        s -= 1e4 * (pairs(x.reshape(n, 3, BLOCK, 1)) == v.none).transpose(0, 2, 1)  # nothing is attended to where nothing stands
        s -= s.max(2, keepdims=True)
        s = np.exp(s, out=s)
        s /= s.sum(2, keepdims=True)
        u = s @ val
        u += np.take(e, inv[:, BLOCK:], axis=0).reshape(2 * n, BLOCK, WIDTH)
        target = y.ravel()
        live = np.flatnonzero(target != v.none)
        target, m = target[live], max(1, len(live))
        u = np.take(u.reshape(-1, WIDTH), live, axis=0)
        before = u @ self.w1
        before += self.b1
        g1 = np.maximum(before, 0)
        h = g1 @ self.w2
        h += u
        p, cls = _softmax(h @ self.c + self.cb), v.cls[target]
        at = np.arange(len(target))
        loss = -np.log(p[at, cls]).sum()
        p[at, cls] -= 1
        p /= np.float32(m)
        grads = {"c": h.T @ p, "cb": p.sum(0), "o": np.zeros_like(self.o), "ob": np.zeros_like(self.ob)}
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1))
        sorted_h, within, dh_sorted = np.take(h, order, axis=0), target[order], np.zeros_like(h)
        for j in range(CLASSES - 1):
            a, z, lo, hi = ends[j], ends[j + 1], v.edges[j], v.edges[j + 1]
            if a == z or hi - lo < 2:
                continue
            g = _softmax(sorted_h[a:z] @ self.o[lo:hi].T + self.ob[lo:hi])
            i = np.arange(z - a)
            loss -= np.log(g[i, within[a:z] - lo]).sum()
            g[i, within[a:z] - lo] -= 1
            g /= np.float32(m)
            dh_sorted[a:z] = g @ self.o[lo:hi]
            grads["o"][lo:hi], grads["ob"][lo:hi] = g.T @ sorted_h[a:z], g.sum(0)
        dh = p @ self.c.T
        dh[order] += dh_sorted
        d1 = dh @ self.w2.T
        d1 *= before > 0
        grads |= {"w2": g1.T @ dh, "w1": u.T @ d1, "b1": d1.sum(0)}
        du = np.zeros((2 * n * BLOCK, WIDTH), np.float32)
        du[live] = d1 @ self.w1.T + dh
        du = du.reshape(2 * n, BLOCK, WIDTH)
        ds = du @ val.transpose(0, 2, 1)
        ds -= (s * ds).sum(2, keepdims=True)
        ds *= s
        grads["near"] = np.bincount(_DISTANCE.ravel(), ds.sum(0).ravel(), 2 * BLOCK).astype(np.float32)
        # By position: gradients of its key and value, which two blocks use, of its query, and of its state.
        d = np.zeros((n, 3, BLOCK, w.shape[1] + WIDTH), np.float32)
        for columns, g in ((slice(0, KEYS), ds.transpose(0, 2, 1) @ q), (slice(KEYS, KEYS + WIDTH), s.transpose(0, 2, 1) @ du)):
            g = g.reshape(n, 2, 2, BLOCK, -1)
            d[:, 0, :, columns], d[:, 1, :, columns], d[:, 2, :, columns] = g[:, 0, 0], g[:, 0, 1] + g[:, 1, 0], g[:, 1, 1]
        d[:, 1:, :, KEYS + WIDTH : w.shape[1]] = (ds @ k).reshape(n, 2, BLOCK, KEYS)
        d[:, 1:, :, w.shape[1] :] = du.reshape(n, 2, BLOCK, WIDTH)
        by = np.argsort(inv.ravel(), kind="stable")
        d = np.add.reduceat(np.take(d.reshape(-1, d.shape[3]), by, axis=0), np.searchsorted(inv.ravel()[by], np.arange(len(rows))), axis=0)
        dw = e.T @ d[:, : w.shape[1]]
        grads |= {"wk": dw[:, :KEYS], "wv": dw[:, KEYS : KEYS + WIDTH], "wq": dw[:, KEYS + WIDTH :] * np.float32(KEYS**-0.5)}
        grads["e"] = d[:, : w.shape[1]] @ w.T + d[:, w.shape[1] :]
        return float(loss) / m, grads, rows

    def train(self, windows: np.ndarray, begun: float, share: float) -> np.ndarray:
        """Steps over windows; ``begun`` and ``share`` place them in the whole training, which the rate falls with. Gives each row's number of uses."""
        for a in range(0, len(windows), BATCH):
            rate = np.float32(RATE * (1 - begun - share * a / len(windows)) + RATE / 20)
            _, grads, rows = self.gradients(windows[a : a + BATCH])
            for name, g in grads.items():
                mine, squares = getattr(self, name), self.squares[name]
                if name == "e":
                    new = squares[rows] + g * g
                    squares[rows] = new
                    mine[rows] -= rate * g / np.sqrt(new)
                else:
                    squares += g * g
                    mine -= rate * g / np.sqrt(squares)
        return np.bincount(windows.ravel(), minlength=len(self.e)).astype(np.float64)


def _pairs(blocks: np.ndarray) -> np.ndarray:
    """Every block but the first behind the one before it, without a copy."""
    n, size, width = blocks.shape
    return np.lib.stride_tricks.as_strided(blocks, (n - 1, 2 * size, width), blocks.strides, writeable=False)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def weighed(model: Model, uses: np.ndarray) -> list[np.ndarray]:
    """What is summed over models for their mean: states times weights, then the weights; embedded rows weigh by their uses, all else alike."""
    weight = [uses[:, None] if k < 2 else np.ones(1) for k in range(2 * len(PARAMETERS))]
    return [*(x * w for x, w in zip(model.state(), weight, strict=True)), uses, np.ones(1)]


def mean(model: Model, sums: list[np.ndarray]) -> None:
    """Set a model to the mean of others; rows that none used stay."""
    uses, models = sums[-2][:, None], sums[-1]
    old = model.state()
    model.put([np.where(uses > 0, x / np.maximum(uses, 1), o) if k < 2 else x / models for k, (x, o) in enumerate(zip(sums[:-2], old, strict=True))])

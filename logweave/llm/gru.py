"""A gated recurrent language model in numpy: truncated back-propagation, class-factored softmax.

Symbols are numbered so that symbol s is member ``s % members`` of class
``s // members``; its probability is that of the class times that within the class.
Documents are laid end to end in parallel lanes, with the state set to zero where a
document begins and carried from window to window within it.  Lanes may differ in
length; a step works on the lanes that reach it, so that a very long document costs its
own tokens only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

Params = dict[str, np.ndarray]
F32 = np.float32
#: Lanes of a batch, and the symbols seen up to which so few are taken; later on WIDEST.
WIDTHS, WIDEST = ((16, 32_768), (32, 98_304), (64, 262_144), (128, 524_288)), 256


def new_params(symbols: int, classes: int, hidden: int = 24, seed: int = 11, start: np.ndarray | None = None) -> Params:
    """start: expected frequency of each symbol, from which the output biases begin."""
    rng = np.random.default_rng(seed)
    members = -(-symbols // classes)
    freq = np.full(classes * members, 1e-9)
    freq[:symbols] = 1.0 if start is None else np.maximum(start, 1e-3)
    table = freq.reshape(classes, members)
    scale = 1 / np.sqrt(hidden)
    p = {
        "inputs": rng.normal(0, 0.1, (symbols + 1, 3 * hidden)),
        "inner": rng.normal(0, scale, (hidden, 3 * hidden)),
        "classes": rng.normal(0, 0.1, (hidden, classes)),
        "class_bias": np.log(table.sum(1) / table.sum()),
        "words": rng.normal(0, 0.1, (classes, members, hidden)),
        "word_bias": np.log(table / table.sum(1, keepdims=True)),
    }
    return {k: v.astype(F32) for k, v in p.items()}


def lanes(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lane and first step of each document (rows of two), longest first into the shortest lane; lanes' lengths, falling."""
    width = max(1, min(width, len(lengths)))
    heap = [(0, i) for i in range(width)]
    place = np.zeros((len(lengths), 2), np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        at, lane = heap[0]
        place[d] = lane, at
        heapq.heapreplace(heap, (at + int(lengths[d]), lane))
    ends = np.zeros(width, np.int64)
    for at, lane in heap:
        ends[lane] = at
    by = np.argsort(-ends, kind="stable")
    rank = np.empty(width, np.int64)
    rank[by] = np.arange(width)
    place[:, 0] = rank[place[:, 0]]
    return place, ends[by]


class Grid:
    """Inputs, targets and documents of all cells, step by step; a step's cells are its lanes in order."""

    def __init__(self, symbols: np.ndarray, heads: np.ndarray, start_symbol: int, width: int):
        lengths = np.diff(heads)
        place, ends = lanes(lengths, width)
        steps = int(ends[0]) if len(ends) else 0
        self.active = len(ends) - np.searchsorted(ends[::-1], np.arange(steps), side="right")
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        doc = np.repeat(np.arange(len(lengths)), lengths)
        within = np.arange(len(symbols)) - heads[doc]
        at = self.first[place[doc, 1] + within] + place[doc, 0]
        before = np.concatenate([[start_symbol], symbols[:-1]]) if len(symbols) else symbols
        before = np.where(within == 0, start_symbol, before)
        self.inputs, self.targets, self.docs = (np.empty(len(symbols), np.int32) for _ in range(3))
        self.inputs[at], self.targets[at], self.docs[at] = before, symbols, doc
        self.lanes = int(self.active[0]) if steps else 0

    def windows(self, steps: int, cells: int | None = None) -> Iterator[tuple[int, int]]:
        """Ranges of ``steps`` steps; with ``cells``, of as many as hold about so many cells."""
        a, n = 0, len(self.active)
        while a < n:
            b = min(n, a + steps)
            if cells is not None:
                b = min(n, max(a + 1, int(np.searchsorted(self.first, self.first[a] + cells, side="right")) - 1))
            yield a, b
            a = b


class _Cell:
    """The recurrence, with the signs of both gates turned so that a gate is 1 / (1 + exp(x)).

    Reset gate, update gate and candidate are blocks of their own (3, cells, hidden), so that a step works on whole
    runs of memory.
    """

    def __init__(self, p: Params, start: int):
        self.hidden, self.start, self.inputs = p["inner"].shape[0], start, p["inputs"]
        self.inner = _by_gate(p["inner"])
        self.inner[:2] *= -1

    def run(self, h: np.ndarray, x: np.ndarray, active: list[int], keep: bool):
        """States of all cells from state h; with ``keep`` also (state before, r, z, n, candidate's inner part) of each."""
        kind, size = self.inner.dtype, self.hidden
        a = np.empty((3, len(x), size), kind)
        for k in range(3):
            np.take(self.inputs[:, k * size : (k + 1) * size], x, axis=0, out=a[k], mode="clip")
        np.negative(a[:2], out=a[:2])
        u = np.empty_like(a)
        states, n = np.empty(a.shape[1:], kind), np.empty(a.shape[1:], kind)
        before = np.empty_like(states) if keep else None
        fresh = np.flatnonzero(x == self.start)
        ends = np.cumsum(active)
        heads = np.searchsorted(fresh, np.concatenate([[0], ends])).tolist()
        at, h = 0, h.astype(kind)
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the 0 that is meant
            for i, end in enumerate(ends.tolist()):
                h = h[: end - at]
                begun = fresh[heads[i] : heads[i + 1]]
                if keep:
                    before[at:end] = h
                    h = before[at:end]
                elif len(begun):
                    h = h.copy()
                if len(begun):
                    h[begun - at] = 0
                own = u[:, at:end]
                np.matmul(h, self.inner, out=own)
                gates, c, new = own[:2], n[at:end], states[at:end]
                gates += a[:2, at:end]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(own[0], own[2], out=c)
                c += a[2, at:end]
                c *= -2  # tanh(c) = 2 / (1 + exp(-2c)) - 1
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                np.subtract(h, c, out=new)
                new *= own[1]
                new += c
                h, at = new, end
        return states, h, (before, u[0], u[1], n, u[2]) if keep else None


def _by_gate(x: np.ndarray) -> np.ndarray:
    """(rows, 3 * hidden) as contiguous blocks (3, rows, hidden)."""
    return np.ascontiguousarray(x.reshape(len(x), 3, -1).transpose(1, 0, 2))


def _bounds(words: np.ndarray, bias: np.ndarray) -> list[bool]:
    """Whether a class's values can be large for states, which lie in -1 to 1."""
    return ((np.abs(words).sum(-1) + np.abs(bias)).max(axis=-1) > 60).tolist()


def _exp_rows(x: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(x - m) in place of x, and m: the row maxima where a value may be large, else 0."""
    m = F32(0)
    if large and len(x):
        m = x.max(axis=1, keepdims=True)
        x -= m
    np.exp(x, out=x)
    return x, m


class _Scorer:
    """Log probabilities of targets, with biases folded into the products."""

    def __init__(self, p: Params):
        self.classes = np.concatenate([p["classes"], p["class_bias"][None]])
        self.words = np.concatenate([p["words"].transpose(0, 2, 1), p["word_bias"][:, None]], axis=1)
        self.ones = np.ones(max(self.classes.shape[1], self.words.shape[2]), F32)
        self.large, self.large_class = _bounds(p["words"], p["word_bias"]), any(_bounds(p["classes"].T[None], p["class_bias"][None]))

    def __call__(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        members = self.words.shape[2]
        cls, member = np.divmod(targets, members)
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        heads = np.searchsorted(cls[order], np.arange(len(self.words) + 1))
        full = np.ones((len(states), states.shape[1] + 1), F32)
        full[:, :-1] = states[order]
        cls, member = cls[order], member[order]
        out = self._picked(full @ self.classes, cls, self.large_class)
        for c in np.flatnonzero(np.diff(heads)).tolist():
            r = slice(heads[c], heads[c + 1])
            out[r] += self._picked(full[r] @ self.words[c], member[r], self.large[c])
        back = np.empty_like(out)
        back[order] = out
        return back

    def _picked(self, x: np.ndarray, column: np.ndarray, large: bool) -> np.ndarray:
        mine = x[np.arange(len(x)), column]
        e, m = _exp_rows(x, large)
        return mine - (np.ravel(m) + np.log(e @ self.ones[: e.shape[1]]))


def log_probabilities(p: Params, symbols: np.ndarray, heads: np.ndarray, width: int = 256, cells: int = 32_768) -> np.ndarray:
    """Natural log probability of each document's symbols (document d is symbols[heads[d]:heads[d + 1]])."""
    start = len(p["inputs"]) - 1
    grid = Grid(symbols, heads, start, width)
    out = np.zeros(len(heads) - 1)
    h = np.zeros((grid.lanes, p["inner"].shape[0]), F32)
    cell, score = _Cell(p, start), _Scorer(p)
    for a, b in grid.windows(1, cells):
        w = slice(grid.first[a], grid.first[b])
        states, h, _ = cell.run(h, grid.inputs[w], grid.active[a:b].tolist(), False)
        out += np.bincount(grid.docs[w], weights=score(states, grid.targets[w]), minlength=len(out))
    return out


def _outputs(p: Params, states: np.ndarray, targets: np.ndarray, grads: Params) -> np.ndarray:
    """Adds the gradients of minus the targets' log probabilities and returns that of the states."""
    classes, members, _ = p["words"].shape
    cls, member = np.divmod(targets, members)
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    heads = np.searchsorted(cls[order], np.arange(classes + 1))
    states, cls, member = states[order], cls[order], member[order]
    rows, ones = np.arange(len(targets)), np.ones(max(classes, members), F32)
    large, large_class = _bounds(p["words"], p["word_bias"]), any(_bounds(p["classes"].T[None], p["class_bias"][None]))

    def errors(x: np.ndarray, column: np.ndarray, large: bool) -> np.ndarray:
        e, _ = _exp_rows(x, large)
        e *= (1 / (e @ ones[: e.shape[1]]))[:, None]
        e[rows[: len(e)], column] -= 1
        return e

    dc = errors(states @ p["classes"] + p["class_bias"], cls, large_class)
    grads["classes"] += states.T @ dc
    rows_one = np.ones(len(targets), F32)
    grads["class_bias"] += rows_one @ dc
    d = dc @ p["classes"].T
    for c in np.flatnonzero(np.diff(heads)).tolist():
        r = slice(heads[c], heads[c + 1])
        s, words = states[r], p["words"][c]
        dw = errors(s @ words.T + p["word_bias"][c], member[r], large[c])
        grads["words"][c] += dw.T @ s
        grads["word_bias"][c] += rows_one[: len(dw)] @ dw
        d[r] += dw @ words
    back = np.empty_like(d)
    back[order] = d
    return back


def _cut(heads: np.ndarray, longest: int) -> np.ndarray:
    """Heads of the parts of at most ``longest`` symbols."""
    parts = -(-np.diff(heads) // longest)
    first = np.cumsum(parts) - parts
    within = np.arange(int(parts.sum())) - np.repeat(first, parts)
    return np.append(np.repeat(heads[:-1], parts) + within * longest, heads[-1])


class Trainer:
    """AdaGrad over windows of truncated back-propagation."""

    def __init__(self, p: Params, rate: float = 0.08, squares: Params | None = None, seen: int = 0):
        """squares, seen: the sums of squared gradients and the symbols of training before this."""
        self.p, self.rate, self.seen = p, rate, seen
        self.squares = squares or {k: np.full_like(v, 1e-3) for k, v in p.items()}

    def learn(self, symbols: np.ndarray, heads: np.ndarray) -> None:
        """One pass over the documents, in batches of more lanes the more symbols were seen."""
        d, n = 0, len(heads) - 1
        while d < n:
            width = next((w for w, below in WIDTHS if self.seen < below), WIDEST)
            e = min(n, max(d + 1, int(np.searchsorted(heads, heads[d] + 4096 * width))))
            self.fit(symbols[heads[d] : heads[e]], heads[d : e + 1] - heads[d], width)
            self.seen += int(heads[e] - heads[d])
            d = e

    def _update(self, name: str, rows, g: np.ndarray) -> None:
        s = self.squares[name][rows] + g * g
        self.squares[name][rows] = s
        np.sqrt(s, out=s)
        g = g / s
        g *= self.rate
        self.p[name][rows] -= g

    def fit(self, symbols: np.ndarray, heads: np.ndarray, width: int = 128, steps: int = 32, longest: int = 1024) -> None:
        """One pass over the documents; a long one is learnt from in parts of ``longest`` symbols, side by side."""
        p = self.p
        start, hidden = len(p["inputs"]) - 1, p["inner"].shape[0]
        grid = Grid(symbols, _cut(heads, longest), start, width)
        h = np.zeros((grid.lanes, hidden), F32)
        for a, b in grid.windows(steps):
            w = slice(grid.first[a], grid.first[b])
            x, y, active = grid.inputs[w], grid.targets[w], grid.active[a:b].tolist()
            states, h, (before, r, z, n, un) = _Cell(p, start).run(h, x, active, True)
            grads = {k: np.zeros_like(v) for k, v in p.items() if k != "inputs"}
            back = _outputs(p, states, y, grads)
            slopes = np.empty((3, *n.shape), n.dtype)  # of r, z and n
            np.multiply(1 - z, 1 - n * n, out=slopes[2])
            np.multiply((before - n) * z, 1 - z, out=slopes[1])
            np.multiply(un * r, 1 - r, out=slopes[0])
            slopes[0] *= slopes[2]
            dx, du = np.empty_like(slopes), np.empty_like(slopes)
            inner, fresh = _by_gate(p["inner"]).transpose(0, 2, 1).copy(), x == start
            starts = np.add.accumulate([0, *active])
            some = np.add.reduceat(fresh, starts[:-1]).tolist()
            carry = np.zeros((active[-1], hidden), F32)
            at = len(x)
            for i in range(len(active) - 1, -1, -1):
                cells = slice(at - active[i], at)
                at -= active[i]
                dh, d, own = back[cells], dx[:, cells], du[:, cells]
                dh[: len(carry)] += carry
                np.multiply(dh, slopes[:, cells], out=d)
                own[:2] = d[:2]
                np.multiply(d[2], r[cells], out=own[2])
                carry = dh * z[cells]
                for part in np.matmul(own, inner):
                    carry += part
                if some[i]:
                    carry[fresh[cells]] = 0
            grads["inner"] += np.matmul(before.T, du).transpose(1, 0, 2).reshape(hidden, -1)
            dx = dx.transpose(1, 0, 2).reshape(len(x), -1)
            scale = F32(1 / max(len(x), 1))
            order = np.argsort(x.astype(np.uint16) if start < 65_536 else x, kind="stable")
            ids, first = np.unique(x[order], return_index=True)
            if len(ids):
                self._update("inputs", ids, np.add.reduceat(dx[order], first, axis=0) * scale)
            for k, g in grads.items():
                g *= scale
                self._update(k, slice(None), np.clip(g, -5, 5, out=g))


def flatten(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(flat: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(F32)
        at += like[k].size
    return out

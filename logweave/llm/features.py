"""Hashed word n-gram features of texts, as sparse rows.

Two families share one hashed space of ``2**bits`` indices: n-grams over words
(runs of ASCII letters, digits and non-ASCII bytes, lower-cased), and n-grams
over the *shapes* of blank-separated words, where runs of lower-case, upper-case,
digit and non-ASCII bytes shrink to one sign each and punctuation stays itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from logweave.llm import textkernel as tk

_NOT_WORD = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NOT_WORD[_a:_b] = False

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 1
_SHAPE[65:91] = 2
_SHAPE[48:58] = 3
_SHAPE[128:] = 4


@dataclass(frozen=True)
class FeatureSpec:
    """bits: log2 of the hashed space; words, shapes: longest n-gram of each family
    (0: none); prefixes: lengths in bytes of word beginnings that are features too;
    presence: 1 for each feature present, else the square root of its share of the
    row's n-grams, so that a family's squares sum to 1."""

    bits: int = 18
    words: int = 2
    shapes: int = 2
    presence: bool = False
    prefixes: tuple[int, ...] = ()


def _grams(hashes: np.ndarray, first: np.ndarray, n: int, salt: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every n-gram of n items."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    acc = np.full(m, zlib.crc32(salt.encode()), np.uint64)
    for j in range(n):
        acc = (acc + hashes[j : j + m]) * tk._M1
    whole = rows[:m] == rows[n - 1 :]
    return rows[:m][whole], (tk.mix(acc[whole]) >> np.uint64(64 - bits)).astype(np.int64)


def _shape_hashes(w: tk.Words, raw: np.ndarray) -> np.ndarray:
    shape = _SHAPE[raw]
    lens = w.ends - w.starts
    if len(lens) == 0:
        return np.zeros(0, np.uint64)
    heads = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(int(lens.sum())) + np.repeat(w.starts - heads, lens)
    s = shape[at]
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[heads] = True
    place = np.cumsum(keep) - 1
    kept, heads = s[keep], place[heads]
    within = np.arange(len(kept)) - np.repeat(heads, np.diff(np.append(heads, len(kept))))
    codes = tk._BYTE[kept] * tk.powers(int(within.max()) + 1)[within]
    return tk.mix(np.add.reduceat(codes, heads))


def sparse_rows(buf: np.ndarray, offsets: np.ndarray, spec: FeatureSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature index and value of all rows, and the head of each row (n + 1)."""
    parts = []
    if spec.words:
        spaced = np.where(_NOT_WORD[buf], np.uint8(32), buf)
        w = tk.Words(spaced, offsets)
        parts += [_grams(w.hashes, w.first, n, f"w{n}", spec.bits) for n in range(1, spec.words + 1)]
        for n in spec.prefixes:
            rows = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
            long = np.flatnonzero(w.ends - w.starts >= n)
            h = np.full(len(long), zlib.crc32(f"p{n}".encode()), np.uint64)
            for j in range(n):
                h = (h + tk._BYTE[w.buf[w.starts[long] + j]]) * tk._M1
            parts.append((rows[long], (tk.mix(h) >> np.uint64(64 - spec.bits)).astype(np.int64)))
    if spec.shapes:
        w = tk.Words(buf, offsets, hashed=False, lower=False)
        h = _shape_hashes(w, buf)
        parts += [_grams(h, w.first, n, f"s{n}", spec.bits) for n in range(1, spec.shapes + 1)]
    idx, val, row_of = [], [], []
    n_rows = len(offsets) - 1
    for rows, ids in parts:
        key = np.sort((rows << spec.bits) | ids)
        if len(key) == 0:
            continue
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(new, len(key)))
        r = key[new] >> spec.bits
        if spec.presence:
            v = np.ones(len(new), np.float32)
        else:
            v = np.sqrt(tf / np.bincount(r, weights=tf, minlength=n_rows)[r]).astype(np.float32)
        idx.append(key[new] & ((1 << spec.bits) - 1))
        val.append(v)
        row_of.append(r)
    if not idx:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(n_rows + 1, np.int64)
    idx, val, row_of = map(np.concatenate, (idx, val, row_of))
    order = np.argsort(row_of, kind="stable")
    return idx[order], val[order], np.searchsorted(row_of[order], np.arange(n_rows + 1))


def dot_rows(buf: np.ndarray, offsets: np.ndarray, spec: FeatureSpec, weights: np.ndarray) -> np.ndarray:
    """Sparse dot product of every row with the weights, chunk by chunk."""
    out = np.zeros(len(offsets) - 1)
    for a, b in tk.chunks(offsets):
        idx, val, heads = sparse_rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], spec)
        sums = np.concatenate([[0.0], np.cumsum(weights[idx].astype(np.float64) * val)])
        out[a:b] = sums[heads[1:]] - sums[heads[:-1]]
    return out


def rows_of(buf: np.ndarray, offsets: np.ndarray, spec: FeatureSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in tk.chunks(offsets):
        idx, val, heads = sparse_rows(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], spec)
        for r in range(b - a):
            yield idx[heads[r] : heads[r + 1]], val[heads[r] : heads[r + 1]]

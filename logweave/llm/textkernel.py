"""Vectorised text kernels shared by the Arrow-batched operators.

Everything here works on the raw UTF-8 bytes of an Arrow string column, so no
Python object is made per document or per word.  Words are the maximal runs of
bytes outside ``\\x20`` and ``\\x09-\\x0D``; lower-casing touches ``A-Z`` only.
Work is cut into chunks of about ``CHUNK`` bytes, which bounds memory whatever
the length of a batch or of one text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_S30, _S27, _S31 = U64(30), U64(27), U64(31)

#: One pseudo-random odd-ish code per byte value, from a rule.
_BYTE = None


#: mallopt's numbers: free memory at the heap's end that is kept, the size from which memory is mapped, and the number of arenas.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _M_ARENA_MAX = -1, -3, -8

try:
    _libc = ctypes.CDLL("libc.so.6")
    _trim = _libc.malloc_trim
    _libc.mallopt(_M_TRIM_THRESHOLD, 16 << 20)
    _libc.mallopt(_M_MMAP_THRESHOLD, 16 << 20)
    _libc.mallopt(_M_ARENA_MAX, 1)
    pa.set_memory_pool(pa.system_memory_pool())
except (OSError, AttributeError):  # another C library: it keeps what is freed

    def _trim(_: int) -> int:
        return 0


def release() -> None:
    """Hand freed memory back to the system: workers outlive their tasks, and what one stage freed the next cannot use."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def tidy(run: Callable) -> Callable:
    """A function of record batches that releases memory when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def trimmed(run: Callable) -> Callable:
    """A function of columns that releases memory after each batch."""

    @functools.wraps(run)
    def wrapped(*columns):
        out = run(*columns)
        release()
        return out

    return wrapped


def lowered(buf: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return buf + ((buf - np.uint8(65)) < 26) * np.uint8(32)


def spaces(buf: np.ndarray) -> np.ndarray:
    """True for bytes that part words."""
    return ((buf - np.uint8(9)) <= 4) | (buf == 32)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), elementwise; the argument is not changed."""
    x = x + _MULT
    x ^= x >> _S30
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


_BYTE = mix(np.arange(256, dtype=U64))
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(255, U64(0xD6E8FEB86659FD93))]), dtype=U64)


#: Bytes whose words are hashed at once.
_BLOCK = 1 << 17
_DOWN: list[np.ndarray] = []


def _inverse_powers() -> np.ndarray:
    """p**0 .. p**-(_BLOCK - 1) modulo 2**64."""
    if not _DOWN:
        step = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _DOWN.append(np.cumprod(np.concatenate([[U64(1)], np.full(2 * _BLOCK, step)]), dtype=U64))
    return _DOWN[0]


def powers(n: int) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64 for the odd word multiplier p."""
    global _POWERS
    if n > len(_POWERS):
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, U64(0xD6E8FEB86659FD93))]), dtype=U64)
    return _POWERS[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets (n + 1) of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    if data is not None and data.size > 1 << 20:
        release()
    offsets = np.frombuffer(offs, np.int64, count=n + 1, offset=column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose bytes come to about ``size``; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of consecutive rows: byte ranges, hashes, and the row range of each.

    starts, ends: byte positions of each word in ``buf``; first: index of each
    row's first word (n + 1 entries); hashes: 64-bit hash of the lower-cased word.
    """

    __slots__ = ("buf", "ends", "first", "hashes", "starts")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, hashed: bool = True, lower: bool = True):
        self.buf = buf = lowered(buf) if lower else buf
        n = len(buf)
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, U64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        word = ~spaces(buf)
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        edges = offsets[:-1]
        edges = edges[edges < n]
        begin[edges] = word[edges]
        close = word.copy()
        close[:-1] &= ~word[1:]
        edges = offsets[1:]
        edges = edges[edges > 0] - 1
        close[edges] = word[edges]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(close) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashed else np.zeros(0, U64)

    def _hash(self) -> np.ndarray:
        """Sum of byte codes times powers of the place in the word, as differences of running sums over a block."""
        starts, ends, out = self.starts, self.ends, np.empty(len(self.starts), U64)
        up, down = powers(2 * _BLOCK), _inverse_powers()
        a, n = 0, len(starts)
        while a < n:
            low = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, low + 2 * _BLOCK, side="right")))
            b = min(b, max(a + 1, int(np.searchsorted(starts, low + _BLOCK))))
            high = ends[b - 1]
            if high - low > 2 * _BLOCK:
                out[a] = _long_hash(self.buf[low:high])
            else:
                sums = np.zeros(high - low + 1, U64)
                codes = _BYTE.take(self.buf[low:high], mode="clip")
                codes *= up[: high - low]
                np.cumsum(codes, out=sums[1:])
                s = starts[a:b] - low
                out[a:b] = (sums[ends[a:b] - low] - sums[s]) * down[s]
            a = b
        return mix(out)


def _long_hash(word: np.ndarray) -> np.uint64:
    """The same word hash, for one very long word, in blocks."""
    step, total, scale = 1 << 20, U64(0), U64(1)
    p = powers(step)
    with np.errstate(over="ignore"):
        for i in range(0, len(word), step):
            part = _BYTE[word[i : i + step]]
            total += scale * np.add.reduce(part * p[: len(part)])
            scale *= p[-1] * p[1]
    return total


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words of each row, and first index per row (n + 1).

    A row with 1 to k - 1 words gives one shingle, the whole sequence; a row
    without words gives none.  Repeats within a row are kept.
    """
    h, first = w.hashes, w.first
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    heads = np.concatenate([[0], np.cumsum(made)])
    if len(h) == 0:
        return np.zeros(0, U64), heads
    acc = np.zeros(len(h), U64)
    mults = mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    for j in range(k):
        m = len(h) - j
        if m > 0:
            acc[:m] += h[j:] * mults[j]
    rows = np.repeat(np.arange(len(counts)), made)
    at = np.arange(heads[-1]) - heads[rows] + first[rows]
    out = acc[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for r in short:
        c = int(counts[r])
        seq = h[first[r] : first[r + 1]]
        with np.errstate(over="ignore"):
            out[heads[r]] = (seq * mults[:c]).sum(dtype=U64) + mix(np.array([c], U64))[0]
    return mix(out), heads


def distinct_in_rows(values: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their heads."""
    if len(values) == 0:
        return values, np.zeros(len(heads), np.int64)
    rows = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(heads)))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def int64s(array: pa.Array, null: int = 0) -> np.ndarray:
    return pc.fill_null(array.cast(pa.int64()), null).to_numpy(zero_copy_only=False)

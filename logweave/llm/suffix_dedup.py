"""Exact removal of repeated substrings by sorted suffixes.

Every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id,
or the same document and an earlier start) is removed.  Suffixes are taken at *anchors*
only: in every window of ``length`` bytes the position whose k-gram has the smallest
hash, with k chosen so that equal windows have equal anchors.  About one position in 32
is an anchor.

1. Each task lists its anchors with a hash of the k-gram and one of the whole context
   that any window around the anchor can reach.  Of equal contexts in one task only the
   first goes on; the others are covered entirely.  Packed by k-gram, they meet.
2. Of anchors with equal k-gram and context all but the first are covered entirely.
   Where one k-gram has several contexts, the first anchor of each is still open.
3. Open anchors' suffixes are cut from their texts, sorted and front-coded in every
   task, exchanged by k-gram and merged by a loser tree that never compares a known
   prefix again.  The merge's common prefixes and those of the sorted left contexts tell,
   for each of the windows around an anchor, which anchors have it in common; all but
   the first of these are covered.
   A k-gram with very many open contexts is not gathered: all windows around its anchors
   are compared by a 128-bit hash instead, equal ones collapsing in every task first.
4. The covered ranges meet their texts by document, and what is left is hashed.

Texts cross the network in compressed packs, twice; no text, list of anchors or range is
broadcast or sent to the driver.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.packs import batch_rows, deal, pack, unpack
from logweave.llm.small_side import bounded_batches
from logweave.llm.suffix_runs import front_code, front_decode, merged
from logweave.plans.scratch import written

U64 = np.uint64
_NULL_ID = -(1 << 63)
_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))
_CODES = (tk.mix(np.arange(256, dtype=U64)), tk.mix(np.arange(256, dtype=U64) + U64(0x1234567)))
_INDEX = U64((1 << 24) - 1)
#: K-grams with more open contexts than this are settled window by window, not in one task.
HOT = 20_000
_HOT_BIT = U64(1 << 63)
#: Bytes whose anchors are found at once.
_SPAN = 1 << 19
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, inverse: bool, n: int) -> np.ndarray:
    made = _powers.get((base, inverse))
    if made is None or len(made) < n:
        b = int(_BASES[base])
        step = U64(pow(b, -1, 1 << 64) if inverse else b)
        made = _powers[base, inverse] = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, step)]), dtype=U64)
    return made[:n]


@dataclass(frozen=True)
class Plan:
    """length: bytes of the repeated string; span: positions among which a window's anchor is chosen (a power of two)."""

    length: int = 100

    @property
    def span(self) -> int:
        return 1 << max(0, (2 * self.length // 3).bit_length() - 1)

    @property
    def gram(self) -> int:
        return self.length - self.span + 1


class _Hashes:
    """Hashes of any byte range of a buffer, in constant time each."""

    def __init__(self, buf: np.ndarray, base: int):
        n = len(buf)
        self.inverse = _power(base, True, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_CODES[base][buf] * _power(base, False, n), out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return tk.mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def _anchors_of_span(buf: np.ndarray, offsets: np.ndarray, plan: Plan) -> np.ndarray:
    """Anchor positions in the buffer of whole texts at most 2**24 bytes long together (or of one part of a text)."""
    n, k, span = len(buf), plan.gram, plan.span
    if n < plan.length:
        return np.zeros(0, np.int64)
    sums = _Hashes(buf, 0)
    m = n - k + 1
    key = tk.mix((sums.sums[k:] - sums.sums[:m]) * sums.inverse[:m])
    key &= ~_INDEX
    key |= np.arange(m, dtype=U64)
    s = 1
    while s < span:
        np.minimum(key[:-s], key[s:], out=key[:-s])
        s *= 2
    lengths = np.diff(offsets)
    windows = np.maximum(lengths - plan.length + 1, 0)
    starts = np.arange(int(windows.sum())) + np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows)
    chosen = np.zeros(m, bool)
    chosen[(key[starts] & _INDEX).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def anchors(buf: np.ndarray, offsets: np.ndarray, plan: Plan) -> tuple[np.ndarray, ...]:
    """(row, position in the row, k-gram hash, context hash) of the anchors of a batch of texts."""
    out = []
    k, left, length = plan.gram, plan.span - 1, plan.length

    def hashed(part: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.maximum(at - left, lo), np.minimum(at + length, hi)
        first, second = _Hashes(part, 0), _Hashes(part, 1)
        lens = ((at - a) * 512 + (b - at)).astype(U64)
        return first.of(at, at + k), tk.mix(second.of(a, b) ^ (lens * U64(0x9E3779B97F4A7C15)))

    for a, b in tk.chunks(offsets, _SPAN):
        if b - a == 1 and offsets[b] - offsets[a] > _SPAN:
            base, end = int(offsets[a]), int(offsets[b])
            found = []
            for s in range(base, end - length + 1, _SPAN):
                e = min(end, s + _SPAN + length - 1)
                found.append(s + _anchors_of_span(buf[s:e], np.array([0, e - s]), plan))
            every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            for s in range(base, end, _SPAN):
                at = every[(every >= s) & (every < s + _SPAN)]
                if len(at):
                    lo, hi = max(base, s - left), min(end, s + _SPAN + length)
                    kh, ch = hashed(buf[lo:hi], at - lo, np.full(len(at), base - lo), np.full(len(at), end - lo))
                    out.append((np.full(len(at), a), at - base, kh, ch))
            continue
        part, offs = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        at = _anchors_of_span(part, offs, plan)
        if len(at):
            row = np.searchsorted(offs, at, side="right") - 1
            kh, ch = hashed(part, at, offs[row], offs[row + 1])
            out.append((row + a, at - offs[row], kh, ch))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U64, U64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Order of the rows by the columns, the first leading."""
    return np.lexsort(columns[::-1])


def _doc_bucket(doc: np.ndarray, version: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(doc.view(U64) ^ (version.view(U64) << U64(1))) % U64(buckets)).astype(np.int64)


def _covered(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, version: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    for b, rows in deal(_doc_bucket(doc, version, buckets), buckets):
        yield b, 0, pack(doc[rows], version[rows], lo[rows], hi[rows])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Bytes, offsets, doc ids and versions of a few MB of texts at a time."""
    for batch in batches:
        buf, offsets = tk.utf8(tk.column(batch, "text"))
        doc = tk.int64s(tk.column(batch, "doc_id"), _NULL_ID)
        version = tk.int64s(tk.column(batch, "version"))
        for a, b in tk.chunks(offsets, 4 << 20):
            yield buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc[a:b], version[a:b]


def _list_anchors(plan: Plan, buckets: int):
    """Texts to (bucket, kind, pack): kind 0 covered ranges by document, kind 1 anchors by k-gram."""
    left, length = plan.span - 1, plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, offsets, doc_of, version_of in _parts(batches):
            size_of = np.diff(offsets)
            row, pos, kh, ch = anchors(buf, offsets, plan)
            if not len(row):
                continue
            kh &= U64((1 << 48) - 1)
            doc, version, size = doc_of[row], version_of[row], size_of[row]
            order = _first_of(kh, ch, doc, pos)
            kh, ch, doc, version, size, pos = (x[order] for x in (kh, ch, doc, version, size, pos))
            again, _ = _repeats(kh, ch, doc, pos)
            lo, hi = np.maximum(pos - left, 0), np.minimum(pos + length, size)
            cover = again & (hi - lo >= length)
            rows = list(_covered(lo[cover], hi[cover], doc[cover], version[cover], buckets))
            keep = ~again
            docs, at = np.unique(np.stack([doc[keep], version[keep], size[keep]]), axis=1, return_inverse=True)
            kh, ch, pos, at = kh[keep], ch[keep], pos[keep], at.reshape(-1)
            for b, r in deal((tk.mix(kh) % U64(buckets)).astype(np.int64), buckets):
                mine, index = np.unique(at[r], return_inverse=True)
                rows.append((b, 1, pack(kh[r], ch[r], index.astype(np.uint32), pos[r].astype(np.uint64), docs[0][mine], docs[1][mine], docs[2][mine])))
            yield batch_rows(["bucket", "kind", "pack"], rows)

    return run


def _repeats(kh, ch, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (kh, ch, doc, pos): whether an equal context starts earlier, and where contexts begin."""
    n = len(kh)
    begins = np.ones(n, bool)
    begins[1:] = (kh[1:] != kh[:-1]) | (ch[1:] != ch[:-1])
    first = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    return ~begins & ((doc != doc[first]) | (pos != pos[first])), begins


def _settle(plan: Plan, buckets: int, hot: int):
    """Anchors of a k-gram bucket to covered ranges (kind 0) and open anchors (kind 1), both by document."""
    left, length = plan.span - 1, plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p.as_py()) for b in batches for p in b.column("pack")]
        if not parts:
            return
        kh, ch, pos = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
        doc, version, size = (np.concatenate([p[i][p[2]] for p in parts]) for i in (4, 5, 6))
        pos = pos.astype(np.int64)
        del parts
        order = np.argsort(kh)
        k = kh[order]
        twice = np.zeros(len(k), bool)
        twice[1:] |= k[1:] == k[:-1]
        twice[:-1] |= k[1:] == k[:-1]
        rows = order[twice]
        kh, ch, doc, version, size, pos = (x[rows] for x in (kh, ch, doc, version, size, pos))
        if not len(kh):
            return
        order = _first_of(kh, ch, doc, pos)
        kh, ch, doc, version, size, pos = (x[order] for x in (kh, ch, doc, version, size, pos))
        again, begins = _repeats(kh, ch, doc, pos)
        lo, hi = np.maximum(pos - left, 0), np.minimum(pos + length, size)
        cover = again & (hi - lo >= length)
        out = list(_covered(lo[cover], hi[cover], doc[cover], version[cover], buckets))
        grams = np.concatenate([[0], np.cumsum(kh[1:] != kh[:-1])])
        contexts = np.bincount(grams[begins])
        still = begins & (contexts[grams] > 1)
        kh = np.where(contexts[grams] > hot, kh | _HOT_BIT, kh)
        doc, version, pos, kh = doc[still], version[still], pos[still], kh[still]
        out += [(b, 1, pack(doc[r], version[r], pos[r], kh[r])) for b, r in deal(_doc_bucket(doc, version, buckets), buckets)]
        if out:
            yield batch_rows(["bucket", "kind", "pack"], out)

    return run


def _pack_texts(buckets: int):
    """Texts to compressed packs by document bucket (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for buf, offsets, doc, version in _parts(batches):
            rows = []
            for b, r in deal(_doc_bucket(doc, version, buckets), buckets):
                text = b"".join(buf[offsets[i] : offsets[i + 1]].tobytes() for i in r.tolist())
                head = pack(doc[r], version[r], np.diff(offsets)[r])
                rows.append((b, 2, struct.pack("<Q", len(head)) + head + squeeze.compress(text)))
            yield batch_rows(["bucket", "kind", "pack"], rows)

    return run


def _texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    (n,) = struct.unpack_from("<Q", blob)
    doc, version, size = unpack(blob[8 : 8 + n])
    return doc, version, np.concatenate([[0], np.cumsum(size)]), zstandard.ZstdDecompressor().decompress(blob[8 + n :], max_output_size=int(size.sum()) + 1)


def _lists_then_texts(batches: Iterator[pa.RecordBatch], width: int):
    """The lists of a bucket, by document, and then its text packs one at a time."""
    lists: list[list[np.ndarray]] = []
    keyed = None
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("pack"), strict=True):
            if kind < 2:
                lists.append(unpack(blob.as_py()))
                continue
            if keyed is None:
                columns = [np.concatenate([x[i] for x in lists]) for i in range(width)] if lists else [np.zeros(0, np.int64)] * width
                order = np.lexsort((columns[2], columns[1], columns[0]))
                columns = [c[order] for c in columns]
                new = np.ones(len(order), bool)
                new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
                heads = np.append(np.flatnonzero(new), len(order))
                keyed = {(int(columns[0][h]), int(columns[1][h])): (int(h), int(e)) for h, e in zip(heads[:-1], heads[1:], strict=True)}
                lists.clear()
            yield keyed, columns, _texts(blob.as_py())


def _cut_suffixes(plan: Plan, buckets: int):
    """Open anchors and texts of a document bucket to front-coded sorted runs of suffixes, by k-gram bucket."""
    left, length = plan.span - 1, plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, versions, poss, grams, suffixes, lefts = [], [], [], [], [], []
        hot: list[tuple[int, int, int, bytes, bytes]] = []

        def runs() -> pa.RecordBatch:
            where = (tk.mix(np.array(grams, U64)) % U64(buckets)).astype(np.int64)
            out = []
            for b, r in deal(where, buckets):
                order = sorted(r.tolist(), key=suffixes.__getitem__)
                lcps, lengths, rest = front_code([suffixes[i] for i in order])
                before = [lefts[i] for i in order]
                numbers = (np.array([x[i] for i in order], t) for x, t in ((docs, np.int64), (versions, np.int64), (poss, np.int64)))
                arrays = [np.frombuffer(x, np.uint8) for x in (lcps, lengths, rest, bytes(map(len, before)), b"".join(before))]
                out.append((b, 2, pack(*numbers, *arrays)))
            for x in (docs, versions, poss, grams, suffixes, lefts):
                x.clear()
            return batch_rows(["bucket", "kind", "pack"], out)

        for keyed, (_, _, pos, kh), (doc, version, offsets, text) in _lists_then_texts(batches, 4):
            for i, key in enumerate(zip(doc.tolist(), version.tolist(), strict=True)):
                if key not in keyed:
                    continue
                a, b = keyed[key]
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                for p, g in zip(pos[a:b].tolist(), kh[a:b].tolist(), strict=True):
                    at = lo + p
                    if g >> 63:
                        hot.append((key[0], key[1], p, text[max(lo, at - left) : at], text[at : min(hi, at + length)]))
                        continue
                    docs.append(key[0])
                    versions.append(key[1])
                    poss.append(p)
                    grams.append(g)
                    suffixes.append(text[at : min(hi, at + length)])
                    lefts.append(text[max(lo, at - left) : at][::-1])
            if len(docs) > 400_000:
                yield runs()
            if len(hot) > 20_000:
                yield _windows_of(hot, plan, buckets)
        if docs:
            yield runs()
        if hot:
            yield _windows_of(hot, plan, buckets)

    return run


def _windows_of(hot: list[tuple[int, int, int, bytes, bytes]], plan: Plan, buckets: int) -> pa.RecordBatch:
    """Every window around the anchors of hot k-grams by a 128-bit hash: of equal ones the first goes on, by
    hash (kind 1), the others are covered (kind 0, by document)."""
    left, length = plan.span - 1, plan.length
    doc, version, pos = (np.array([h[i] for h in hot], t) for i, t in ((0, np.int64), (1, np.int64), (2, np.int64)))
    before, after = (np.array([len(h[i]) for h in hot]) for i in (3, 4))
    buf = np.frombuffer(b"".join(h[3] + h[4] for h in hot), np.uint8)
    at = np.cumsum(before + after) - after
    hot.clear()
    first, second = _Hashes(buf, 0), _Hashes(buf, 1)
    parts = []
    for back in range(left + 1):
        rows = np.flatnonzero((before >= back) & (after >= length - back))
        a = at[rows] - back
        parts.append((first.of(a, a + length), second.of(a, a + length), doc[rows], version[rows], pos[rows] - back))
    out = _first_windows_of(*(np.concatenate(c) for c in zip(*parts, strict=True)), length, buckets, True)
    return batch_rows(["bucket", "kind", "pack"], out)


def _first_windows_of(h1, h2, doc, version, start, length: int, buckets: int, go_on: bool) -> list[tuple[int, int, bytes]]:
    order = _first_of(h1, h2, doc, start)
    h1, h2, doc, version, start = (x[order] for x in (h1, h2, doc, version, start))
    again, _ = _repeats(h1, h2, doc, start)
    out = list(_covered(start[again], start[again] + length, doc[again], version[again], buckets))
    if go_on:
        keep = np.flatnonzero(~again)
        for b, r in deal((tk.mix(h1[keep]) % U64(buckets)).astype(np.int64), buckets):
            r = keep[r]
            out.append((b, 1, pack(h1[r], h2[r], doc[r], version[r], start[r])))
    return out


def _settle_windows(plan: Plan, buckets: int):
    """Windows of a hash bucket to covered ranges: all but the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(p.as_py()) for b in batches for p in b.column("pack")]
        if parts:
            out = _first_windows_of(*(np.concatenate([p[i] for p in parts]) for i in range(5)), plan.length, buckets, False)
            if out:
                yield batch_rows(["bucket", "kind", "pack"], out)

    return run


def _compare_windows(plan: Plan, buckets: int):
    """Runs of one k-gram bucket, merged, to the covered ranges of every window around each anchor."""
    span, length = plan.span, plan.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [unpack(p.as_py()) for b in batches for p in b.column("pack")]
        if not packs:
            return
        runs = [(front_decode(p[3].tobytes(), p[4].tobytes(), p[5].tobytes()), p[3].tolist()) for p in packs]
        order, lcp = merged(runs)
        right = np.concatenate([p[4] for p in packs]).astype(np.int64)[order]
        doc, version, pos = (np.concatenate([p[i] for p in packs])[order] for i in range(3))
        before = np.concatenate([p[6] for p in packs]).astype(np.int64)
        n = len(order)
        matrix = np.zeros((n, -(-(span - 1) // 8) * 8 or 8), np.uint8)
        inside = np.arange(matrix.shape[1]) < before[:, None]
        matrix[inside] = np.concatenate([p[7] for p in packs])
        matrix, before = matrix[order], before[order]
        words = matrix.view(">u8")
        by_left = np.lexsort(words.T[::-1])
        differ = matrix[by_left[1:]] != matrix[by_left[:-1]]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), span)
        places, rank = np.unique(np.stack([doc, pos]), axis=1, return_inverse=True)
        rank = rank.reshape(-1).astype(U64)
        covered = np.zeros((n, span), bool)
        left_class = np.zeros(n, np.int64)
        for back in range(span):
            rows = np.flatnonzero((before >= back) & (right >= length - back))
            if len(rows) < 2:
                continue
            right_class = np.cumsum(lcp < length - back)
            left_class[by_left] = np.concatenate([[0], np.cumsum(shared < back)])
            both = right_class[rows].astype(U64) * U64(n + 1) + left_class[rows].astype(U64)
            o = np.lexsort((rank[rows], both))
            c, r = both[o], rank[rows][o]
            head = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(o)), 0))
            covered[rows[o[r != r[head]]], back] = True
        del places
        edges = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edges == 1)
        _, high = np.nonzero(edges == -1)
        lo, hi = pos[row] - (high - 1), pos[row] - low + length
        out = list(_covered(lo, hi, doc[row], version[row], buckets))
        if out:
            yield batch_rows(["bucket", "kind", "pack"], out)

    return run


def _strike_out(with_text: bool, characters: bool):
    """Covered ranges and texts of a document bucket to what is left of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter[tuple[int, int]] = Counter()
        for keyed, (_, _, lo, hi), (doc, version, offsets, text) in _lists_then_texts(batches, 4):
            rows = []
            for i, (d, v) in enumerate(zip(doc.tolist(), version.tolist(), strict=True)):
                a, b = int(offsets[i]), int(offsets[i + 1])
                spans = 0
                kept = memoryview(text)[a:b]
                if (d, v) in keyed:
                    s, e = keyed[d, v]
                    ends = np.maximum.accumulate(hi[s:e])
                    begin = np.concatenate([[True], lo[s + 1 : e] > ends[:-1]])
                    starts, stops = lo[s:e][begin], ends[np.append(np.flatnonzero(begin)[1:] - 1, e - s - 1)]
                    spans = len(starts)
                    edges = zip([0, *stops.tolist()], [*starts.tolist(), b - a], strict=True)
                    kept = b"".join(kept[x:y] for x, y in edges)
                left = bytes(kept) if with_text else None
                rows.append((None if d == _NULL_ID else d, b - a, b - a - len(kept), spans, hashlib.sha256(kept).hexdigest(), v, met[d, v], left.decode("utf-8", "ignore") if with_text and characters else left))
                met[d, v] += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int64(), pa.string() if characters else pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "version", "copy", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def text_version(text: Column) -> Column:
    """A hash of a whole text, null being empty, which tells rows that repeat a doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False, hot: int = HOT, characters: bool = False) -> DataFrame:
    """What is left of every document without its repeated ``length``-byte strings.

    docs has doc_id (integer) and text.  Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 (lowercase hex), version (``text_version``), copy
    (numbers rows of equal id and text from 0) and, if asked for, kept (the remaining bytes;
    else null).  With characters, kept is a string: of a character of which some bytes go, the
    others go too.
    One row for each row of docs.  Null and empty texts have no bytes; texts shorter than
    ``length`` lose none.  Rows without a doc_id count as one document that comes first,
    and so do rows that repeat a doc_id: a string is not earlier than itself.  Other
    columns are not read.  The table must give the same rows whenever it is read.
    """
    if not 24 <= length <= 255:
        raise ValueError("length must be from 24 to 255 bytes")
    spark = docs.sparkSession
    plan = Plan(length)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "bucket int, kind int, pack binary"
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_version(F.col("text")).alias("version"))

    listed = written(docs.mapInArrow(tk.tidy(_list_anchors(plan, buckets)), schema), "anchors")
    settled = listed.where("kind = 1").repartitionById(buckets, F.col("bucket")).mapInArrow(tk.tidy(_settle(plan, buckets, hot)), schema)
    settled = written(settled, "settled")

    texts = docs.mapInArrow(tk.tidy(_pack_texts(buckets)), schema)

    def with_texts(lists: DataFrame) -> DataFrame:
        return lists.unionByName(texts).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")

    def met(rows: DataFrame, run) -> DataFrame:
        return rows.repartitionById(buckets, F.col("bucket")).mapInArrow(tk.tidy(run(plan, buckets)), schema)

    cut = written(with_texts(settled.where("kind = 1")).mapInArrow(tk.tidy(_cut_suffixes(plan, buckets)), schema), "runs")
    compared = met(cut.where("kind = 2"), _compare_windows).unionByName(met(cut.where("kind = 1"), _settle_windows))
    covered = listed.where("kind = 0").unionByName(settled.where("kind = 0")).unionByName(cut.where("kind = 0")).unionByName(written(compared, "windows"))
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, version bigint, copy bigint, kept " + ("string" if characters else "binary")
    return with_texts(covered).mapInArrow(tk.tidy(_strike_out(with_text, characters)), out)

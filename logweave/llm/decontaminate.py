"""Benchmark decontamination by latent semantic retrieval.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; terms are words
hashed to ``TERMS`` places, so that the term space has one size whatever the corpus or
benchmark.  One pass over all texts lists the terms of every passage and counts in how
many each occurs.  A randomised singular value decomposition of the TF-IDF matrix A of
all passages follows: two subspace steps Q <- orth(A'AQ) from a random block, each a pass
over the listed terms that is spread over all tasks and sends one array back for each.
The leading ``RANK`` right singular vectors fold a piece of text into the latent space,
divided by their singular values as far as many passages stand behind these: else those
that tell languages and common words apart would outweigh the rest.  Items of the benchmark
have no part in that space; they are cut into passages and folded in like any text.

The last pass folds in the windows of a document around which enough words of an item stand,
compares them with its passages by cosine, and checks candidates by the longest common
subsequence of words and, where the benchmark gives one, by the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.features import _NOT_WORD
from logweave.llm.packs import pack, unpack
from logweave.llm.small_side import bounded_batches, folded
from logweave.plans.scratch import written

#: Words of a block; windows of so many blocks begin at every block: the short one for items' passages of at most SHORT_WORDS.
BLOCK, SHORT, LONG = 16, 2, 3
PASSAGE, SHORT_WORDS = BLOCK * LONG, 28
#: Hashed terms; dimensions of the latent space; further random directions of the decomposition.
TERM_BITS, RANK, EXTRA = 14, 96, 16
TERMS = 1 << TERM_BITS
#: Terms in the most passages, which are multiplied together.
COMMON = 256
#: Squared singular values are taken as larger by this (a number of passages), so that directions of few passages are not blown up.
RIDGE = 50.0
#: Items' passages that are searched for in one pass; a larger benchmark takes several, in the same space.
ROUND = 1024
#: Words of a greater idf, those in fewer than about 1 passage in 20, count as rare.
RARE = float(np.log(20.0) + 1)
#: Leading bits of a word's hash by which most words that no item holds are told.
SEEN_BITS = 18
#: Leading bits of a word's hash by which an item's words are counted before it is compared; blocks that are counted together.
SLOT_BITS, SPAN = 12, 16
#: Bytes of texts that are worked on at once.
CHUNK = 1 << 19
#: Bytes of words in lower case, a space for every other.
_SPACED = np.where(_NOT_WORD, np.uint8(32), tk.lowered(np.arange(256, dtype=np.uint8))).tobytes()
_SUMS = "at int, sums binary, n bigint"
_LISTED = "kind int, pack binary, n bigint"
_FOUND = "doc_id bigint, item_id bigint, cosine double, coverage double, answer double"


def _words(buf: np.ndarray, offsets: np.ndarray) -> tk.Words:
    return tk.Words(np.frombuffer(buf.tobytes().translate(_SPACED), np.uint8), offsets, lower=False)


def _terms(hashes: np.ndarray) -> np.ndarray:
    return (tk.mix(hashes) >> np.uint64(64 - TERM_BITS)).astype(np.uint16)


def lcs_length(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, one machine word (or more) of bits at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = where.get(y)
        if hit is not None:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass(frozen=True)
class Items:
    """ids and word hashes of the items, and their answers' words (empty where none is given)."""

    ids: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]

    def passages(self) -> tuple[list[int], list[np.ndarray]]:
        """The item of each passage, and its words: every PASSAGE words, the last ones once more if they leave a short rest."""
        item, words = [], []
        for i, w in enumerate(self.words):
            starts = list(range(0, max(1, len(w) - PASSAGE + 1), PASSAGE))
            if len(w) > PASSAGE and starts[-1] + PASSAGE < len(w):
                starts.append(len(w) - PASSAGE)
            item += [i] * len(starts)
            words += [w[s : s + PASSAGE] for s in starts]
        return item, words


def _items(rows: list, has_answer: bool) -> Items:
    def hashes(texts: list[str]) -> list[np.ndarray]:
        buf, offsets = tk.utf8(pa.array(texts, pa.large_string()))
        w = _words(buf, offsets)
        return [w.hashes[a:b] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]

    words = hashes([r["text"] or "" for r in rows])
    answers = hashes([(r["answer"] or "") if has_answer else "" for r in rows])
    full = [i for i, w in enumerate(words) if len(w)]
    return Items([rows[i]["item_id"] for i in full], [words[i] for i in full], [answers[i] for i in full])


def _cut(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of every piece of at most ``size`` words, and the first piece of each row (n + 1)."""
    counts = np.diff(w.first)
    per_row = -(-counts // size)
    heads = np.concatenate([[0], np.cumsum(per_row)])
    within = np.arange(int(heads[-1])) - np.repeat(heads[:-1], per_row)
    return np.repeat(w.first[:-1], per_row) + within * size, heads


def _sums_row(total: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.ascontiguousarray(total, np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["at", "sums", "n"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for batch in batches:
        for s, m in zip(batch.column("sums"), batch.column("n").to_pylist(), strict=True):
            x = np.frombuffer(s.as_py(), np.float32)
            total = x.astype(np.float64) if total is None else total + x
            n += m
    if total is not None:
        yield _sums_row(total, n)


def _gather(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Sum of the arrays of all tasks; the driver gets a single one."""
    found = folded(rows, _summed, "sums").collect()
    return sum((np.frombuffer(r.sums, np.float32) for r in found), np.zeros(size)), sum(r.n for r in found)


def _list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to packs of the terms and lengths of their passages (kind 0) and the number of passages with each term (kind 1)."""
    df, n = np.zeros(TERMS), 0

    def row(kind: int, blob: bytes, count: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([blob], pa.binary()), pa.array([count], pa.int64())], names=["kind", "pack", "n"])

    for batch in batches:
        buf, offsets = tk.utf8(tk.column(batch, "text"))
        for a, b in tk.chunks(offsets):
            w = _words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(w.starts):
                continue
            first, _ = _cut(w, PASSAGE)
            term, lengths = _terms(w.hashes), np.diff(np.append(first, len(w.starts)))
            kind = np.uint32 if len(first) < 1 << (32 - TERM_BITS) else np.uint64
            pairs = np.sort((np.repeat(np.arange(len(first), dtype=kind), lengths) << kind(TERM_BITS)) | term)
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
            df += np.bincount((pairs & kind(TERMS - 1)).astype(np.int64), minlength=TERMS)
            n += len(first)
            yield row(0, pack(term, lengths.astype(np.uint8)), len(first))
    if n:
        yield row(1, df.astype(np.float32).tobytes(), n)


def _run_sums(source: np.ndarray, rows: np.ndarray, heads: np.ndarray, counts: np.ndarray, most: int = 2048) -> np.ndarray:
    """Sum of source[rows[h : h + c]] for each head h and count c, in one product for ``most`` rows of runs of one length."""
    out = np.zeros((len(heads), source.shape[1]), np.float32)
    order = np.argsort(counts, kind="stable")
    edges = np.flatnonzero(np.diff(counts[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        size = int(counts[order[a]])
        step, ones = max(1, most // max(1, size)), np.ones((1, size), np.float32)
        for c in range(a, b if size else a, step):
            at = order[c : min(b, c + step)]
            out[at] = np.matmul(ones, source[rows[heads[at][:, None] + np.arange(size)]])[:, 0]
    return out


def _piece_sums(values: np.ndarray, first: np.ndarray, term: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each piece's terms."""
    return _run_sums(values, term, first, ends - first)


def _add_rows(total: np.ndarray, ids: np.ndarray, rows: np.ndarray, source: np.ndarray, run: int = 16) -> None:
    """total[ids] += source[rows], with ids sorted and repeated; of each id, ``run`` rows are made one until fewer are left."""
    while len(ids):
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        counts = np.diff(np.append(heads, len(ids)))
        whole, rest = counts // run, counts % run
        some = np.flatnonzero(rest)
        total[ids[heads[some]]] += _run_sums(source, rows, (heads + whole * run)[some], rest[some])
        of, within = _spread(whole)
        source = _run_sums(source, rows, heads[of] + within * run, np.full(len(of), run))
        ids, rows = ids[heads[of]], np.arange(len(of))


def _apply(idf: np.ndarray, block: np.ndarray, common: np.ndarray, most: int = 4096):
    """Packs of terms to the sum of A'A block over a task's passages, ``most`` passages at a time.

    Terms of ``common`` are counted for each passage and multiplied at once, both ways, the others added up.
    """
    weighted = (idf[:, None] * block).astype(np.float32)
    idf, width = idf.astype(np.float32), block.shape[1]
    squares = idf**2
    place = np.full(TERMS, -1, np.int64)
    place[common] = np.arange(len(common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((TERMS, width), np.float32), False
        of_common = np.zeros((len(common), width), np.float32)
        for batch in batches:
            for p in batch.column("pack"):
                terms, lengths = unpack(p.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                for a in range(0, len(ends), most):
                    b, low = min(len(ends), a + most), int(ends[a - 1]) if a else 0
                    t, size = terms[low : ends[b - 1]], lengths[a:b].astype(np.int64)
                    passage, slot = np.repeat(np.arange(b - a), size), place[t]
                    known = slot >= 0
                    counts = np.bincount(passage[known] * len(common) + slot[known], minlength=(b - a) * len(common)).reshape(b - a, len(common)).astype(np.float32)
                    rare, passage = t[~known].astype(np.int64), passage[~known]
                    some = np.bincount(passage, minlength=b - a)
                    y = counts @ weighted[common] + _run_sums(weighted, rare, np.cumsum(some) - some, some)
                    y /= np.add.reduceat(squares[t], np.cumsum(size) - size)[:, None]
                    of_common += counts.T @ y
                    order = np.argsort(t[~known], kind="stable")
                    _add_rows(total, rare[order], passage[order], y)
                    any_ = True
        if any_:
            total[common] += of_common
            total *= idf[:, None]
            yield _sums_row(total.ravel(), 0)

    return run


def latent_space(texts: DataFrame, rank: int = RANK, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """idf of every hashed term, and the fold-in matrix: idf times right singular vectors over damped singular values.

    texts has a text column.  A's rows are the passages of all texts; the row of a passage
    holds its words' idf, scaled to about unit length.  Directions whose singular value is under
    a thousandth of the largest are left out.
    """
    listed = written(texts.select("text").mapInArrow(tk.tidy(_list_terms), _LISTED), "terms")
    df, n = _gather(listed.where("kind = 1").select(F.lit(0).alias("at"), F.col("pack").alias("sums"), "n"), TERMS)
    idf = np.log((1 + n) / (1 + df)) + 1
    packs = listed.where("kind = 0").select("pack")
    block = np.random.default_rng(seed).normal(size=(TERMS, rank + EXTRA)).astype(np.float32)
    values = np.zeros(0)
    common = np.argsort(-df, kind="stable")[:COMMON]
    for _ in range(2):
        made, _ = _gather(packs.mapInArrow(tk.tidy(_apply(idf, block, common)), _SUMS), block.size)
        block, values, _ = np.linalg.svd(made.reshape(block.shape), full_matrices=False)
    keep = np.flatnonzero(values[:rank] > 1e-6 * max(values[0], 1e-30)) if n else np.zeros(0, np.int64)
    if not len(keep):
        return idf, np.zeros((TERMS, 0), np.float32)
    return idf, (idf[:, None] * block[:, keep] / np.sqrt(values[keep] + RIDGE)).astype(np.float32)


def fold_in(words: list[np.ndarray], fold: np.ndarray) -> np.ndarray:
    """Unit latent vectors of lists of word hashes; a zero row where none of the words has a place in the space."""
    made = np.stack([fold[_terms(w)].sum(0) for w in words]) if words else np.zeros((0, fold.shape[1]), np.float32)
    return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)


class _RareWords:
    """A bound on common subsequences: an item of n words of which r are rare shares a part c of its words only with a
    text that holds at least r - (1 - c) n of its rare ones, repeats counted.  Any choice of rare words gives a bound."""

    def __init__(self, items: Items, idf: np.ndarray, share: float):
        rare = [w[idf[_terms(w)] > RARE] for w in items.words]
        self.lengths = np.array([len(w) for w in items.words])
        needed = np.array([len(r) - (1 - share) * len(w) for r, w in zip(rare, items.words, strict=True)])
        self.needed = np.maximum(np.ceil(needed - 1e-9), 0).astype(np.int64)
        pairs = np.unique(np.stack([np.concatenate(rare), np.repeat(np.arange(len(rare)), [len(r) for r in rare]).astype(np.uint64)]), axis=1) if rare else np.zeros((2, 0), np.uint64)
        self.words, self.first = np.unique(pairs[0], return_index=True)
        self.first = np.append(self.first, pairs.shape[1])
        self.item = pairs[1].astype(np.int64)
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self._short(self.words)] = True

    @staticmethod
    def _short(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SEEN_BITS)).view(np.int64)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every rare word of an item among the words h, by place."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[self._short(h)])  # few words go on to the search
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        right = np.flatnonzero(self.words[at] == h[maybe])
        hit, at = maybe[right], at[right]
        of, inner = _spread(self.first[at + 1] - self.first[at])
        return hit[of], self.item[self.first[at][of] + inner]


class _AnyWords:
    """A bound on common subsequences by all words of an item, told apart by ``SLOT_BITS`` of their hashes: no text shares
    more of an item's words than the sum, over its slots, of the words in the text, up to those in the item."""

    def __init__(self, items: Items, share: float):
        slots = [np.unique(self._short(w), return_counts=True) for w in items.words]
        self.least = np.array([share * len(w) for w in items.words]) - 1e-9
        self.of = np.full((len(slots), 1 << SLOT_BITS), -1, np.int16)
        for of, (slot, _) in zip(self.of, slots, strict=True):
            of[slot] = np.arange(len(slot))
        self.counts = np.concatenate([c for _, c in slots])
        self.first = np.cumsum([0] + [len(c) for _, c in slots])

    @staticmethod
    def _short(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def enough(self, h: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the words low to high of h can hold the share of the item, for each of the items."""
        out = np.zeros(len(item), bool)
        for part in _slices(high - low, 1 << 17):
            i = item[part]
            of, within = _spread(high[part] - low[part])
            slot = self.of.ravel()[i[of] * self.of.shape[1] + self._short(h[low[part][of] + within])]
            hit = np.flatnonzero(slot >= 0)
            slots = self.first[i + 1] - self.first[i]
            begin = np.cumsum(slots) - slots
            held = np.bincount(begin[of[hit]] + slot[hit], minlength=int(slots.sum()))
            of, within = _spread(slots)
            out[part] = np.add.reduceat(np.minimum(held, self.counts[self.first[i][of] + within]), begin) >= self.least[i]
        return out


def _able_runs(first: np.ndarray, rare: _RareWords, place: np.ndarray, of_item: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, row, first place, last place) of as many rare words of an item, one after the other in a row, as it needs.

    By item, row and place.  Those too far apart for any window are left out, as are items that need none.
    """
    of, at = of_item[rare.needed[of_item] > 0], place[rare.needed[of_item] > 0]
    order = np.argsort(of * (int(first[-1]) + 1) + at)
    of, at = of[order], at[order]
    begin = np.arange(len(of))
    end = np.minimum(begin + rare.needed[of] - 1, max(len(of) - 1, 0))
    begin = np.flatnonzero((end - begin == rare.needed[of] - 1) & (of[end] == of) & (at[end] - at < BLOCK * LONG + 2 * rare.lengths[of]))
    end = end[begin]
    row = np.searchsorted(first, at[begin], side="right") - 1
    same = at[end] < first[row + 1]
    return of[begin[same]], row[same], at[begin[same]], at[end[same]]


def _able_spans(w: tk.Words, heads: np.ndarray, size: int, rare: _RareWords, any_: _AnyWords, runs: tuple[np.ndarray, ...], mine: np.ndarray) -> tuple[np.ndarray, ...]:
    """(item, row, first block, blocks) of the windows of ``size`` blocks around which enough of an item's words stand.

    Words around a window are those up to the item's length away.  First there must be as many rare
    words as the item needs; of windows next to each other, up to ``SPAN``, the words are then counted
    together.  No window of an item is there twice; an item that needs no rare words, if it is one
    of ``mine``, has all windows of all rows to begin with.
    """
    item, row, low, high = runs
    base, reach, blocks = w.first[row], rare.lengths[item], np.diff(heads)
    begin = np.maximum((high - size * BLOCK - reach - base) // BLOCK + 1, 0)
    end = np.minimum((low + reach - base) // BLOCK + 1, blocks[row])
    again = np.flatnonzero((item[1:] == item[:-1]) & (row[1:] == row[:-1])) + 1
    begin[again] = np.maximum(begin[again], end[again - 1])
    some = np.flatnonzero((begin < end) & mine[item])
    item, row, begin, end = (x[some] for x in (item, row, begin, end))
    apart = np.ones(len(item), bool)
    apart[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (begin[1:] != end[:-1])
    edges = np.flatnonzero(apart)
    end = end[np.append(edges[1:], len(item))[: len(edges)] - 1]
    free = np.flatnonzero(mine & (rare.needed == 0))
    item, row = np.concatenate([item[edges], np.repeat(free, len(blocks))]), np.concatenate([row[edges], np.tile(np.arange(len(blocks)), len(free))])
    begin, end = np.concatenate([begin[edges], np.zeros(len(free) * len(blocks), np.int64)]), np.concatenate([end, np.tile(blocks, len(free))])
    of, within = _spread(-((begin - end) // SPAN))
    item, row, begin, end = item[of], row[of], begin[of] + within * SPAN, np.minimum(begin[of] + (within + 1) * SPAN, end[of])
    low = np.maximum(w.first[row] + begin * BLOCK - rare.lengths[item], w.first[row])
    high = np.minimum(w.first[row] + (end - 1 + size) * BLOCK + rare.lengths[item], w.first[row + 1])
    some = any_.enough(w.hashes, item, low, high)
    return item[some], row[some], (heads[row] + begin)[some], (end - begin)[some]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each count as often as it says, and 0, 1, ... within each."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _slices(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of the counts that add up to at most ``most``, or hold one."""
    ends, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def _candidates(w: tk.Words, fold: np.ndarray, sides: list[tuple[int, np.ndarray, np.ndarray]], rare: _RareWords, any_: _AnyWords, near: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first word, words, item, cosine) of windows near an item's passage.

    Only windows around which enough of the item's words stand are folded in; the others cannot
    hold a leak.
    """
    first, heads = _cut(w, BLOCK)
    ends = np.append(first[1:], len(w.hashes))
    runs = _able_runs(w.first, rare, *rare.hits(w.hashes))
    for size, latent, item in sides:
        order = np.argsort(item, kind="stable")
        begin = np.searchsorted(item[order], np.arange(len(rare.needed) + 1))
        passages = np.diff(begin)
        of_item, of_row, head, count = _able_spans(w, heads, size, rare, any_, runs, passages > 0)
        for part in _slices(count * passages[of_item], 1 << 13):
            of, within = _spread(count[part])
            at, i, row = head[part][of] + within, of_item[part][of], of_row[part][of]
            which, window = np.unique(at, return_inverse=True)
            last = heads[np.searchsorted(heads, which, side="right")]  # the end of the window's row
            used = np.unique(np.concatenate([np.minimum(which + j, last - 1) for j in range(size)]))
            words = ends[used] - first[used]
            of, within = _spread(words)
            edges = np.cumsum(words)
            sums = _piece_sums(fold, edges - words, _terms(w.hashes[first[used][of] + within]), edges)
            windows = sums[np.searchsorted(used, which)]
            for j in range(1, size):
                more = np.flatnonzero(which + j < last)
                windows[more] += sums[np.searchsorted(used, which[more] + j)]
            windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-12)
            k, inner = _spread(passages[i])
            p = order[begin[i][k] + inner]
            cos = np.concatenate([np.einsum("ij,ij->i", windows[window[k[a : a + 8192]]], latent[p[a : a + 8192]]) for a in range(0, len(k), 8192)])
            near_ = np.flatnonzero(cos >= near)
            if len(near_):
                found = k[near_]
                yield row[found], first[at[found]], np.full(len(found), size * BLOCK), i[found], cos[near_]


def _find(items: Items, idf: np.ndarray, fold: np.ndarray, near: float, copied: float, paraphrased: float, answered: float):
    item_of, passages = items.passages()
    rare, any_ = _RareWords(items, idf, paraphrased), _AnyWords(items, paraphrased)
    latent, item_of = fold_in(passages, fold), np.array(item_of)
    short = np.array([len(p) <= SHORT_WORDS for p in passages])
    sides = [(size, latent[mine], item_of[mine]) for size, mine in ((SHORT, short), (LONG, ~short))]
    listed = [w.tolist() for w in items.words]
    distinct = [np.unique(w, return_counts=True) for w in items.words]

    def judge(i: int, shared: list[int], region: np.ndarray) -> tuple[float, float, bool]:
        cover = lcs_length(listed[i], shared) / len(listed[i])
        if cover < paraphrased:
            return cover, 0.0, False
        if not len(items.answers[i]):
            return cover, 0.0, True
        reply = lcs_length(items.answers[i].tolist(), region.tolist()) / len(items.answers[i])
        return cover, reply, cover >= copied or reply >= answered

    def pair(i: int, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cosines: np.ndarray) -> tuple[float, float, float] | None:
        """The best place of an item among a row's windows that stands the check."""
        n, (words, counts) = len(listed[i]), distinct[i]
        lo, hi = np.maximum(starts - n, 0), np.minimum(starts + sizes + n, len(h))
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        shared = np.flatnonzero(words[at] == h)
        at = at[shared]
        first, last = np.searchsorted(shared, lo), np.searchsorted(shared, hi)
        able = np.flatnonzero(last - first >= paraphrased * n)
        for k in able[np.argsort(-cosines[able], kind="stable")].tolist():
            here = slice(first[k], last[k])
            # no common subsequence holds a word more often than the item does
            if np.minimum(np.bincount(at[here], minlength=len(words)), counts).sum() < paraphrased * n:
                continue
            cover, reply, leaked = judge(i, h[shared[here]].tolist(), h[lo[k] : hi[k]])
            if leaked:
                return float(cosines[k]), cover, reply
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            ids = tk.column(batch, "doc_id")
            buf, offsets = tk.utf8(tk.column(batch, "text"))
            for a, b in tk.chunks(offsets, CHUNK):
                w = _words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(w.hashes):
                    continue
                parts = list(_candidates(w, fold, sides, rare, any_, near))
                if not parts:
                    continue
                row, start, size, item, cos = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((item, row))
                row, start, size, item, cos = (x[order] for x in (row, start, size, item, cos))
                edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]]))
                for c, d in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    r, i = int(row[c]), int(item[c])
                    low = int(w.first[r])
                    best = pair(i, w.hashes[low : w.first[r + 1]], start[c:d] - low, size[c:d], cos[c:d])
                    if best is not None:
                        found.append((ids[a + r].as_py(), items.ids[i], *best))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], k) for j, k in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "coverage", "answer"])

    return run


def _rounds(items: Items, most: int) -> Iterator[Items]:
    """The items in groups of about ``most`` passages."""
    made = np.array([-(-len(w) // PASSAGE) for w in items.words])
    group = (np.cumsum(made) - made) // most
    for g in np.unique(group):
        at = np.flatnonzero(group == g).tolist()
        yield Items(*([x[i] for i in at] for x in (items.ids, items.words, items.answers)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, near: float = 0.3, copied: float = 0.8, paraphrased: float = 0.6, answered: float = 0.5, space: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, cosine, coverage, answer, a row for each pair.

    docs has doc_id (integer) and text, benchmark item_id (integer), text and, if known,
    answer.  A window whose latent cosine with a passage of an item is at least ``near`` is a
    candidate; coverage is the share of the item's words in the longest common subsequence
    with the text around it.  From ``copied`` on the item has leaked; from ``paraphrased`` on
    it has if no answer is given, or if the share ``answered`` of its words occurs in order
    as well.  space: a latent space of ``latent_space``; by default that of docs.

    Whole texts of all rows are searched, for whole items of any length.  Null and empty
    texts hold nothing; items without words are held by nothing.  Rows that repeat a doc_id
    give their rows each; null ids stay null; of ties in cosine the earlier place counts.
    Other columns are not read.  Only the benchmark and one array of the size of the latent
    space reach the driver; ``ROUND`` passages of items and that space are sent out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    has_answer = "answer" in benchmark.columns
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", *(["answer"] if has_answer else []))
    items = _items(sorted(asked.collect(), key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["text"] or "")), has_answer)
    out = None
    if items.ids:
        idf, fold = space or latent_space(texts)
        tk.release()  # of the driver, after the decomposition
        for part in _rounds(items, ROUND):
            found = texts.mapInArrow(tk.tidy(_find(part, idf, fold, near, copied, paraphrased, answered)), _FOUND)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], _FOUND) if out is None else out  # never joined to others: its rows would come from Python workers of another kind

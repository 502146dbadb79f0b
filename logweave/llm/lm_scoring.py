"""Log-likelihood of whole documents under a gated recurrent language model, beside a unigram base.

Word counts cover all training documents.  Each task adds up the words of its own texts
first; the sums meet by a hash of the word, in packs.  The ``COMMON`` most frequent words, a
table of fixed size, are then known to every task, and are scored where the text is.  Only
the other words of a document, each of which is rarer than all of these, travel to their
counts, and one sum for each document travels back.

Words outside the model's vocabulary fall into ``TAILS`` groups by their last two bytes.
The model predicts the group, and within the group a word has (count + 1) of the group's
total of (count + 1), plus one for words never seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import gru
from logweave.llm import textkernel as tk
from logweave.llm.packs import batch_rows, deal, pack, unpack
from logweave.llm.small_side import bounded_batches, folded
from logweave.plans.scratch import written

TAILS = 64
#: Symbols of the model: tail groups and words, in classes of equal size.
SYMBOLS, CLASSES = 4096, 64
#: Words whose counts every task holds.
COMMON = 1 << 17
U64 = np.uint64
_TAIL = U64(TAILS - 1)
END = U64(0x00E0D0C0B0A09080) & ~_TAIL
_LIST = "bucket int, kind int, pack binary"
_TOTALS = "n long, v long, words binary, counts binary, groups binary"
_SCORED = "kind int, bucket int, pack binary, row bigint, doc_id bigint, train boolean, n_tokens bigint, known bigint, logs double, vocab_logs double, model double"


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, each text's words and then the end, and heads; the low bits are the tail group."""
    w = tk.Words(buf, offsets)
    low = w.buf
    if len(w.starts):
        last = low[w.ends - 1].astype(U64)
        second = np.where(w.ends - w.starts > 1, low[np.maximum(w.ends - 2, 0)], 0).astype(U64)
        h = (w.hashes & ~_TAIL) | (tk.mix(last * U64(256) + second) & _TAIL)
    else:
        h = np.zeros(0, U64)
    heads = w.first + np.arange(len(offsets))
    out = np.full(len(h) + len(offsets) - 1, END, U64)
    keep = np.ones(len(out), bool)
    keep[heads[1:] - 1] = False
    out[keep] = h
    return out, heads


def _token_parts(buf: np.ndarray, offsets: np.ndarray, size: int = 12 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tokens of rows [a, b) of about ``size`` bytes, made from smaller chunks."""
    for a, b in tk.chunks(offsets, size):
        parts, heads = [], [np.zeros(1, np.int64)]
        inner = offsets[a : b + 1]
        for c, d in tk.chunks(inner):
            h, first = tokens(buf[inner[c] : inner[d]], inner[c : d + 1] - inner[c])
            parts.append(h)
            heads.append(first[1:] + heads[-1][-1])
        yield a, b, np.concatenate(parts), np.concatenate(heads)


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined to about ``size`` bytes, so that many documents run beside each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _lists(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return batch_rows(["bucket", "kind", "pack"], rows)


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return (tk.mix(words) % U64(buckets)).astype(np.int64)


def _summed_words(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, back = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(words)).astype(np.int64)


def _count_words(buckets: int, most: int = 1 << 20):
    """Texts to their words with counts, packed by a hash of the word; a task sends each word about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packs() -> pa.RecordBatch:
            words, counts = held.pop()
            return _lists([(b, 0, pack(words[r], counts[r])) for b, r in deal(_bucket_of(words, buckets), buckets)])

        for batch in batches:
            buf, offsets = tk.utf8(tk.column(batch, "text"))
            for _, _, h, _ in _token_parts(buf, offsets, 4 << 20):
                held.append(np.unique(h, return_counts=True))
                if sum(len(w) for w, _ in held) > most:
                    held[:] = [_summed_words(held)]
                    if len(held[0][0]) > most // 2:
                        yield packs()
        if held:
            held[:] = [_summed_words(held)]
            yield packs()

    return run


def _settle_counts(keep: int):
    """Packs of a word bucket to its words with their counts (kind 0), and totals with the commonest words (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for b, p in zip(batch.column("bucket").to_pylist(), batch.column("pack"), strict=True):
                mine = held.setdefault(b, [])
                mine.append(tuple(unpack(p.as_py())))
                if len(mine) >= 16:
                    mine[:] = [_summed_words(mine)]
        for b, parts in held.items():
            words, counts = _summed_words(parts)
            groups = np.bincount((words & _TAIL).astype(np.int64), weights=counts + 1.0, minlength=TAILS)
            top = np.lexsort((words, -counts))[:keep]
            yield _lists([(b, 0, pack(words, counts)), (b, 1, pack(words[top], counts[top], groups, np.array([counts.sum(), len(words)])))])

    return run


def _first_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in batch.column("pack"):
            words, counts, groups, sums = unpack(p.as_py())
            yield _totals_row(words, counts, groups, *sums.tolist())


def _merge_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, counts, groups, n, v = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(TAILS), 0, 0
    for batch in batches:
        for r in batch.to_pylist():
            w, c, g = (np.frombuffer(r[k], t) for k, t in (("words", U64), ("counts", np.int64), ("groups", np.float64)))
            words, counts, groups, n, v = np.concatenate([words, w]), np.concatenate([counts, c]), groups + g, n + r["n"], v + r["v"]
            top = np.lexsort((words, -counts))[:COMMON]
            words, counts = words[top], counts[top]
    if v:
        yield _totals_row(words, counts, groups, n, v)


def _totals_row(words: np.ndarray, counts: np.ndarray, groups: np.ndarray, n: int, v: int) -> pa.RecordBatch:
    columns = [pa.array([int(n)]), pa.array([int(v)]), *(pa.array([x.tobytes()], pa.binary()) for x in (words, counts.astype(np.int64), groups.astype(np.float64)))]
    return pa.RecordBatch.from_arrays(columns, names=["n", "v", "words", "counts", "groups"])


@dataclass(frozen=True)
class Language:
    """The recurrent model with the common words: hashes (sorted), counts and symbols (-1: in a tail group); log10 totals of the groups."""

    params: gru.Params
    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    group_logs: np.ndarray

    def encode(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of distinct token hashes, their counts (0 where not common), and whether they are in the vocabulary."""
        symbols = (h & _TAIL).astype(np.int64)
        if not len(self.words):
            return symbols, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        inside = hit & (self.symbols[at] >= 0)
        return np.where(inside, self.symbols[at], symbols), np.where(hit, self.counts[at], 0), inside

    def symbols_of(self, h: np.ndarray) -> np.ndarray:
        words, back = np.unique(h, return_inverse=True)
        return self.encode(words)[0][back]


def _new_language(words: np.ndarray, counts: np.ndarray, groups: np.ndarray, hidden: int) -> Language:
    """words by falling count; the first of them are the model's vocabulary."""
    inside = min(len(words), SYMBOLS - TAILS)
    left = groups + 1.0
    np.subtract.at(left, (words[:inside] & _TAIL).astype(np.int64), counts[:inside] + 1.0)
    left = np.maximum(left, 1.0)
    start = np.concatenate([left, counts[:inside], np.zeros(SYMBOLS - TAILS - inside)])
    params = gru.new_params(SYMBOLS, CLASSES, hidden, start=start)
    by = np.argsort(words)
    return Language(params, words[by], counts[by], np.where(by < inside, TAILS + by, -1).astype(np.int32), np.log10(left))


def _train_parts(language: Language, rate: float, squares: gru.Params, seen: int):
    """A replica trained on a partition's texts: its parameters and the tokens it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = gru.Trainer({k: v.copy() for k, v in language.params.items()}, rate, {k: v.copy() for k, v in squares.items()}, seen)
        for batch in _gathered(batches):
            buf, offsets = tk.utf8(tk.column(batch, "text"))
            for _, _, h, heads in _token_parts(buf, offsets):
                trainer.learn(language.symbols_of(h), heads)
        if trainer.seen > seen:
            yield _replica(gru.flatten(trainer.p), float(trainer.seen - seen))

    return run


def _replica(flat: np.ndarray, weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.astype(np.float32).tobytes()], pa.binary()), pa.array([weight])], names=["params", "weight"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = None, 0.0
    for batch in batches:
        for p, w in zip(batch.column("params"), batch.column("weight").to_pylist(), strict=True):
            x = np.frombuffer(p.as_py(), np.float32) * np.float64(w)
            total = x if total is None else total + x
            weight += w
    if weight:
        yield _replica(total / weight, weight)


def _score_parts(language: Language, buckets: int):
    """Texts to their sums over common words and the model (kind 0), and their other words packed by word (kind 1)."""
    group_logs, ln10 = language.group_logs, np.log(10.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCORED.split(", ")]
        next_row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packs() -> pa.RecordBatch:
            words, rows, tf = (np.concatenate(c) for c in zip(*rare, strict=True))
            rare.clear()
            out = []
            for b, r in deal(_bucket_of(words, buckets), buckets):
                w, first, many = np.unique(words[r], return_index=True, return_counts=True)
                order = r[np.argsort(words[r], kind="stable")]
                del first
                out.append((b, 1, pack(w, many.astype(np.uint32), rows[order], tf[order])))
            empty = [pa.nulls(len(out), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[0] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary()), *empty], names=names)

        for batch in _gathered(batches):
            buf, offsets = tk.utf8(tk.column(batch, "text"))
            ids, trains = tk.column(batch, "doc_id"), tk.column(batch, "train")
            for a, b, h, heads in _token_parts(buf, offsets):
                n = b - a
                words, back = np.unique(h, return_inverse=True)
                symbols, counts, inside = language.encode(words)
                logs = np.log10(counts + 1.0)
                row = np.repeat(np.arange(n), np.diff(heads))
                mine = symbols[back]
                tails = np.where(inside, 0.0, group_logs[np.minimum(symbols, TAILS - 1)])
                model = gru.log_probabilities(language.params, mine, heads) / ln10
                model -= np.bincount(row, weights=tails[back], minlength=n)
                sums = [np.bincount(row, weights=x[back], minlength=n) for x in ((counts > 0) * 1.0, logs, logs * inside)]
                rows = next_row + np.arange(n)
                next_row += n
                columns = [
                    pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(rows), ids.slice(a, n), trains.slice(a, n),
                    pa.array(np.diff(heads).astype(np.int64)), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.array(model),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                other = np.flatnonzero(counts[back] == 0)
                if len(other):
                    pair, tf = np.unique(back[other] * np.int64(n) + row[other], return_counts=True)
                    rare.append((words[pair // n], rows[pair % n], tf.astype(np.uint32)))
                if sum(len(r[0]) for r in rare) > 1 << 20:
                    yield packs()
        if rare:
            yield packs()

    return run


def _settle_rare(buckets: int):
    """Counts of a word bucket, then packs of words to look up: sums by text, packed by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[np.ndarray, np.ndarray]] = []
        words, counts = np.zeros(1, U64), np.zeros(1, np.int64)
        sums: list[tuple[np.ndarray, ...]] = []

        def packs() -> pa.RecordBatch:
            rows, logs, seen = _sums_by_row(sums)
            sums.clear()
            return _lists([(b, 0, pack(rows[r], logs[r], seen[r])) for b, r in deal(_bucket_of(rows.view(U64), buckets), buckets)])

        for batch in batches:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("pack"), strict=True):
                if kind == 0:
                    known.append(tuple(unpack(p.as_py())))
                    continue
                if known:  # all counts come before the first pack
                    words, counts = _summed_words(known)
                    known.clear()
                w, many, rows, tf = unpack(p.as_py())
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                c = np.repeat(np.where(words[at] == w, counts[at], 0), many)
                sums.append((rows, tf * np.log10(c + 1.0), tf * (c > 0).astype(np.int64)))
                if sum(len(s[0]) for s in sums) > 1 << 20:
                    yield packs()
        if sums:
            yield packs()

    return run


def _sums_by_row(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, logs, seen = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[at], np.add.reduceat(logs[order], at), np.add.reduceat(seen[order], at)


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        for p in batch.column("pack"):
            parts.append(tuple(unpack(p.as_py())))
            if sum(len(x[0]) for x in parts) > 1 << 21:
                parts = [_sums_by_row(parts)]
    if parts:
        rows, logs, seen = _sums_by_row(parts)
        for a in range(0, len(rows), 50_000):
            s = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(rows[s]), pa.array(logs[s]), pa.array(seen[s])], names=["r", "rare_logs", "rare_known"])


def score_documents(docs: DataFrame, held_out: Column, hidden: int = 24, seed_docs: int = 200, rate: float = 0.08) -> DataFrame:
    """Unigram base and recurrent log10 likelihood of every document.

    docs has doc_id (integer) and text; rows for which held_out holds are not learnt
    from.  Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in
    training), train_tokens, base_score (sum of log10((count + 1) / (train_tokens +
    distinct + 1))) and score, one row for each row of docs.  Null and empty texts are the
    end alone.  Rows that repeat a doc_id are scored by their own text.  A table without
    training rows gives every token the same chance.  Other columns are not read.

    Counts cover all training rows.  The recurrent weights start from ``seed_docs`` rows
    and are then trained in one pass over every training row, a replica for each
    partition; replicas are averaged by their tokens.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    train = base.where("train").select("doc_id", "text")

    listed = train.select("text").mapInArrow(tk.tidy(_count_words(buckets)), _LIST).repartitionById(buckets, F.col("bucket"))
    settled = written(listed.mapInArrow(tk.tidy(_settle_counts(COMMON)), _LIST), "counts")
    found = folded(settled.where("kind = 1").select("pack").mapInArrow(_first_totals, _TOTALS), _merge_totals).collect()
    total = next(iter(_merge_totals(iter([pa.RecordBatch.from_pylist([r.asDict() for r in found])]))), None) if found else None
    if total is None:
        n = v = 0
        language = _new_language(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(TAILS), hidden)
    else:
        row = total.to_pylist()[0]
        n, v = row["n"], row["v"]
        language = _new_language(np.frombuffer(row["words"], U64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["groups"]), hidden)

    trainer = gru.Trainer(language.params, rate)
    sample = train.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(seed_docs).select("text").toArrow()
    for _, _, h, heads in _token_parts(*tk.utf8(sample["text"])):
        trainer.learn(language.symbols_of(h), heads)
    replicas = train.select("text").mapInArrow(tk.tidy(_train_parts(language, rate, trainer.squares, trainer.seen)), "params binary, weight double")
    few = folded(replicas, _average).collect()
    if few:
        mean = sum(np.frombuffer(r.params, np.float32) * np.float64(r.weight) for r in few) / sum(r.weight for r in few)
        language = Language(gru.unflatten(mean, language.params), language.words, language.counts, language.symbols, language.group_logs)

    scored = written(base.mapInArrow(tk.tidy(_score_parts(language, buckets)), _SCORED), "scored")
    asked = settled.where("kind = 0").select("bucket", "kind", "pack").unionByName(scored.where("kind = 1").select("bucket", "kind", "pack"))
    asked = asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind")
    sums = asked.mapInArrow(tk.tidy(_settle_rare(buckets)), _LIST).repartitionById(buckets, F.col("bucket"))
    sums = sums.mapInArrow(tk.tidy(_by_row), "r bigint, rare_logs double, rare_known bigint")
    both = scored.where("kind = 0").drop("kind", "bucket", "pack").join(sums, F.col("row") == F.col("r"), "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return both.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("model") + logs - F.col("vocab_logs")).alias("score"),
    )

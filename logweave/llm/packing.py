"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each partition of the documents is one online packer.  It keeps an array that counts,
for every fill level, the partly filled windows at that level, and places a document
where the sum of the squared counts is smallest afterwards: into a window of some
level, or into a new one.  What is longer than a window first fills whole windows of
its own.  At the end of a partition the windows that are still open are filled up from
each other by cutting, and the last one is split at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.small_side import bounded_batches

Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, tokens of the document


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None) -> Callable[[str], np.ndarray]:
    """Token ids of a text under a ``tokenizers`` file, without added special tokens.

    ranks: the same vocabulary as a rank file; ordinary texts are then encoded from it,
    which gives the same ids several times as fast.  Texts that hold the written form of
    a special token, and texts the rank file's encoder cannot take, go through the tokenizer itself.
    """
    made: list = []

    def by_tokenizer(text: str) -> np.ndarray:
        if not made:  # few texts need it, and it takes tens of MB
            from tokenizers import Tokenizer

            made.append(Tokenizer.from_file(tokenizer))
        return np.array(made[0].encode(text, add_special_tokens=False).ids, "<u4")

    if ranks is None:
        return by_tokenizer
    import base64

    import public_tokenizers
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens", [])]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return by_tokenizer(text)
        try:
            return np.array(fast.encode_ordinary(text), "<u4")
        except BaseException as e:  # its regex gives up on very long runs of one kind, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return by_tokenizer(text)

    return encode


class SumOfSquares:
    """Online packer; ``add`` and ``finish`` yield windows as lists of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.levels = np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]

    def place(self, n: int) -> int:
        """The fill level (0: a new window) that takes n tokens at the least sum of squares; ties go to the fullest."""
        size, count = self.size, self.levels
        best, at = 2 * count[n] + 1, 0
        if n < size:
            old = count[1 : size - n]
            cost = np.where(old > 0, 2 * (count[1 + n : size] - old) + 2, np.iinfo(np.int64).max)
            if len(cost):
                h = len(cost) - 1 - int(np.argmin(cost[::-1]))
                if cost[h] <= best:
                    best, at = cost[h], h + 1
            if count[size - n] and 1 - 2 * count[size - n] <= best:
                at = size - n
        return at

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[Piece]]:
        size, total = self.size, len(ids)
        start = 0
        while total - start >= size:
            yield [(doc_id, start, ids[start : start + size], total)]
            start += size
        n = total - start
        if not n:
            return
        h = self.place(n)
        window: list[Piece] = []
        if h:
            window = self.open[h].pop()
            self.levels[h] -= 1
        window.append((doc_id, start, ids[start:], total))
        if h + n == size:
            yield window
        else:
            self.open[h + n].append(window)
            self.levels[h + n] += 1

    def finish(self) -> Iterator[list[Piece]]:
        """Windows of what is still open: fullest first, filled up by cutting, the rest at powers of two."""
        left = [p for level in reversed(self.open) for window in level for p in window]
        rest = sum(len(p[2]) for p in left)
        self.levels[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        room = min(self.size, _power_below(rest)) if rest < self.size else self.size
        window: list[Piece] = []
        for doc_id, start, ids, total in left:
            while len(ids):
                part = ids[:room]
                window.append((doc_id, start, part, total))
                ids, start, room, rest = ids[len(part) :], start + len(part), room - len(part), rest - len(part)
                if not room:
                    yield window
                    window, room = [], self.size if rest >= self.size else _power_below(rest)


def _power_below(n: int) -> int:
    return 1 << (n.bit_length() - 1) if n else 0


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, size: int = 2048, end_id: int = 1, with_tokens: bool = True
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence of at most ``size`` tokens.

    docs has doc_id (integer) and text; a document is the ids of its text, then end_id.
    Returns doc_id, start (ids of the document before the piece), length, ids_crc32 (of
    the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset
    (in the sequence, gapless from 0) and, if asked for, tokens.  Null and empty texts
    are documents of the end id alone; null ids stay null; rows that repeat an id are
    documents of their own; other columns are not read.  Nothing is shuffled: a packer
    works on a partition as it is read, and holds its open windows only.  sequence_id
    has the partition in its upper half, so the partitions must not change between reads.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, ranks), SumOfSquares(size)
        base, made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        rows: list[tuple] = []
        held: list[np.ndarray] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            if with_tokens:
                columns.append(pa.array([h.astype(np.int32) for h in held], pa.list_(pa.int32())))
            out = pa.RecordBatch.from_arrays(columns, names=names + ["tokens"] * with_tokens)
            rows.clear()
            held.clear()
            return out

        def put(window: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for doc_id, start, ids, total in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, offset))
                if with_tokens:
                    held.append(ids)
                offset += len(ids)
            made += 1

        end = np.array([end_id], "<u4")
        for b in batches:
            for doc_id, text in zip(tk.column(b, "doc_id").to_pylist(), tk.column(b, "text"), strict=True):
                for window in packer.add(doc_id, np.concatenate([encode(text.as_py() or ""), end])):
                    put(window)
                if len(rows) >= 4096:
                    yield batch()
        for window in packer.finish():
            put(window)
        if rows:
            yield batch()

    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"{n} bigint" for n in names) + (", tokens array<int>" if with_tokens else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tk.tidy(run), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Token arrays of the sequences: sequence_id and tokens (at most one window), from pieces with tokens."""
    return pieces.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "tokens"))), lambda p: p["tokens"])).alias("tokens")
    )

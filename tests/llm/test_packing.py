import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from logweave.llm.packing import SumOfSquares, pack, sequences

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


def ids_of(texts):
    t = Tokenizer.from_file(JSON)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, want, size):
    """Every id is in exactly one piece and sequences have no gaps; returns the padded share."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want[d])
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(want[d])
    padded = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= size
        total += at
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / total


def test_pieces_hold_every_id_once_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], ids_of([r.text for r in rows]), strict=True))
    out = pack(docs, JSON, RANKS)
    assert check(out.collect(), want, 2048) < 0.001
    joined = {r.sequence_id: r.tokens for r in sequences(out).collect()}
    assert sum(map(len, joined.values())) == sum(map(len, want.values()))


def test_special_strings_nulls_and_repeats(spark):
    texts = ["a <|endoftext|> b", None, "", "  \n\n  x\t", "é" * 5000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, offset int").coalesce(1)
    assert check(pack(docs, JSON, RANKS).collect(), dict(enumerate(ids_of(texts))), 2048) == 0
    assert pack(docs.union(docs), JSON, RANKS).count() >= 10
    assert pack(docs.limit(0), JSON, RANKS).count() == 0
    null = spark.createDataFrame([(None, "x")], "doc_id bigint, text string")
    assert pack(null, JSON).first().doc_id is None


def test_the_place_has_the_least_sum_of_squares():
    rng, size = np.random.default_rng(5), 64
    packer = SumOfSquares(size)
    for n in rng.integers(1, size, 500).tolist():
        before = packer.levels.copy()

        def squares(h, n=n, before=before):
            c = before.copy()
            c[h] -= h > 0
            c[h + n] += h + n < size
            return int((c[1:size] ** 2).sum())

        best = min(squares(h) for h in range(size - n + 1) if h == 0 or before[h])
        list(packer.add(0, np.zeros(n, "<u4")))
        assert int((packer.levels[1:size] ** 2).sum()) == best

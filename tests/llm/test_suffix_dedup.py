import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import suffix_dedup
from logweave.llm.suffix_dedup import remove_repeats
from logweave.llm.suffix_runs import front_code, front_decode, merge_runs

SCHEMA = "doc_id bigint, text string"


def brute_force(rows, length):
    first, removed = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if first.setdefault(s, (d, i)) != (d, i):
                gone[i : i + length] = b"\1" * length
        removed[d] = (b, gone)
    out = []
    for d, (b, gone) in removed.items():
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(3)
    want = brute_force([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert got(remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 1000


def test_edited_copies_repeats_within_a_text_and_giant_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SPAN", 1 << 12)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7)))
    base = [word() for _ in range(400)]
    rows = []
    for d in range(40):
        words = list(base)
        for _ in range(d % 9):
            words[rnd.randrange(400)] = word()
        a = rnd.randrange(300)
        rows.append((d, " ".join(words[a : a + rnd.randint(20, 100)])))
    rows += [(50, " ".join(word() for _ in range(4000)) + rows[3][1] * 3), (51, "x" * 1000), (52, "ab" * 300 + "x" * 150), (53, " ".join(base) * 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(remove_repeats(docs)) == brute_force(rows, 100)
    assert got(remove_repeats(docs, 60)) == brute_force(rows, 60)


def test_hot_grams_are_settled_by_windows(spark):
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = noise(230)
    rows = [(d, noise(rnd.randint(0, 150)) + passage[rnd.randrange(20) :] + noise(rnd.randint(0, 90))) for d in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(remove_repeats(docs, hot=2)) == brute_force(rows, 100)


def test_nulls_empty_short_and_repeated_rows(spark):
    long = "abcdefghij" * 5 + "".join(chr(97 + i * i % 26) for i in range(90))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (6, long), (None, "q" + long)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], SCHEMA + ", n_bytes int")
    out = {(r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()}
    assert out == {(1, 0), (2, 0), (3, 0), (4, 140), (6, 140), (None, 0)}
    assert remove_repeats(docs).count() == 7
    assert remove_repeats(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6)), min_size=1, max_size=6))
def test_merge_of_front_coded_runs(parts):
    runs = []
    for p in parts:
        lcps, lengths, rest = front_code(sorted(p))
        runs.append((front_decode(lcps, lengths, rest), list(lcps)))
        assert runs[-1][0] == sorted(p)
    got, last = [], b""
    for r, i, n in merge_runs(runs):
        s = runs[r][0][i]
        want = next((j for j, (x, y) in enumerate(zip(s, last)) if x != y), min(len(s), len(last)))
        assert not got or n == want
        got.append(s)
        last = s
    assert got == sorted(s for p in parts for s in p)

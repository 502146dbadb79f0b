import random
import re

from hypothesis import given
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa
from logweave.llm import decontaminate as dc
from logweave.llm import textkernel as tk
from logweave.llm.decontaminate import find_leaks, latent_space, lcs_length
from logweave.llm.queries import op5_decontaminate

D, B = "doc_id bigint, text string", "item_id bigint, text string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_lcs(a, b):
    assert lcs_length(a, b) == plain_lcs(a, b)


def test_equals_brute_force_on_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    want = set()
    for doc in docs:
        text = " " + " ".join(words(doc.text)) + " "
        want |= {(doc.doc_id, i.item_id) for i in items if f" {' '.join(words(i.text))} " in text}
    got = {(r.doc_id, r.item_id) for r in op5_decontaminate(spark, d).collect()}
    assert len(want) > 5 and want <= got
    for d_id, i_id in got - want:
        a = words(next(i.text for i in items if i.item_id == i_id))
        b = words(next(x.text for x in docs if x.doc_id == d_id))
        assert plain_lcs(a, b) >= 0.6 * len(a)


def test_paraphrases_and_clean_texts(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    items = [[word() for _ in range(rnd.randint(15, 60))] for _ in range(30)]
    rows, want = [], set()
    for d in range(60):
        text = [word() for _ in range(rnd.randint(0, 300))]
        if d % 2:
            item = list(items[d % 30])
            for _ in range(len(item) // 6):
                item[rnd.randrange(len(item) - 12)] = word()
            at = rnd.randrange(len(text) + 1)
            text[at:at] = item
            want.add((d, d % 30))
        elif d % 4 == 0:
            part = items[d % 30]
            text += part[: len(part) // 3]
        rows.append((d, " ".join(text).title()))
    docs, bench = spark.createDataFrame(rows, D), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], B)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == want


def test_given_answers_nulls_and_empty(spark):
    q = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    near = q.replace("beta", "b").replace("delta", "d").replace("eta ", "e ").replace("mu", "m")
    docs = spark.createDataFrame([(1, near + " forty two"), (2, near), (3, None), (4, ""), (None, q), (5, q), (5, q)], D).selectExpr("*", "1 AS item_id", "2 AS cosine")
    bench = spark.createDataFrame([(7, q, "forty two"), (8, None, None), (9, "", "x"), (10, "...", None)], B + ", answer string")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()), key=str)
    assert got == [(1, 7), (5, 7), (5, 7), (None, 7)]
    assert find_leaks(docs.limit(0), bench).count() == 0
    assert find_leaks(docs, bench.limit(0)).count() == 0


def test_recall_of_the_candidate_search(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    space = latent_space(docs)
    every = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, near=-2.0, space=space).collect()}
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, space=space).collect()}
    assert len(every) > 20 and found <= every and len(found) >= 0.95 * len(every)


def test_items_of_any_length_and_cut_copies(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    items = [[word() for _ in range(n)] for n in (600, 1500, 3000, 40, 40)]
    filler = [word() for _ in range(3000)]
    texts = [filler[i * 100 : i * 100 + 50] + w + filler[-60:] for i, w in enumerate(items[:3])]
    texts += [filler[:70] + items[3][:30] + filler[100:180], filler[:90] + items[4][:20] + filler[300:380], filler]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], D)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], B)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_the_latent_space_finds_what_words_alone_miss(spark):
    rnd = random.Random(6)
    common, topics = [f"c{i}" for i in range(24)], [[f"t{t}w{i}" for i in range(60)] for t in range(20)]

    def passage(t):
        w = common + rnd.sample(topics[t], 24)
        rnd.shuffle(w)
        return w

    texts = [passage(i % 20) + passage(i % 20) for i in range(400)]
    items = [common[:] for _ in range(5)]
    rnd2 = random.Random(7)
    for t, item in enumerate(items):
        rnd2.shuffle(item)
        said = list(item)
        for at in sorted(rnd2.sample(range(25), 16), reverse=True):
            item.insert(at, topics[t][at])
            said.insert(at, topics[t][at + 30])
        texts.append(said + passage(t)[:8])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], D)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], B)
    idf, fold = space = latent_space(docs)
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs, bench, space=space).collect()} == {(400 + t, t) for t in range(5)}

    def vector(words):
        buf, offsets = tk.utf8(pa.array([" ".join(words)]))
        return np.bincount(dc._terms(dc._words(buf, offsets).hashes), minlength=dc.TERMS) * idf

    a, b = vector(items[0]), vector(texts[400][:40])
    assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) < 0.3
    assert fold.shape[1] <= dc.RANK
    a, b = a / np.where(idf > 0, idf, 1) @ fold, b / np.where(idf > 0, idf, 1) @ fold
    assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.3


def test_only_windows_that_can_hold_an_item_are_folded_in(monkeypatch):
    """One copy in a text of 6,000 other words: the windows around it are folded in, not all of the text."""
    item, filler = [" ".join(f"{kind}{i}" for i in range(n)) for kind, n in (("q", 40), ("w", 3_000))]
    items = dc._items([{"item_id": 3, "text": item}], False)
    fold = np.random.default_rng(1).normal(size=(dc.TERMS, 16)).astype(np.float32)
    pieces, sums = [], dc._piece_sums

    def counted(values, first, *rest):
        pieces.append(len(first))
        return sums(values, first, *rest)

    monkeypatch.setattr(dc, "_piece_sums", counted)
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8], "text": [f"{filler} {item} {filler}", filler]})
    find = dc._find(items, np.full(dc.TERMS, 9.0), fold, 0.3, 0.8, 0.6, 0.5)
    found = [r for b in find(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in found] == [(7, 3, 1.0)]
    assert sum(pieces) < 40


def found_in(texts, items, idf, near=0.3):
    """(doc_id, item_id) of texts by _find alone, with a random space."""
    fold = np.random.default_rng(1).normal(size=(dc.TERMS, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    find = dc._find(dc._items([{"item_id": i, "text": t} for i, t in enumerate(items)], False), idf, fold, near, 0.8, 0.6, 0.5)
    return {(r["doc_id"], r["item_id"]) for b in find(iter([batch])) for r in b.to_pylist()}


def test_words_that_repeat_do_not_make_windows_able(monkeypatch):
    """A text that says one of an item's rare words 60 times holds no more of the item; none of its windows is folded in."""
    item, filler = [" ".join(f"{kind}{i}" for i in range(n)) for kind, n in (("q", 40), ("w", 500))]
    pieces, sums = [], dc._piece_sums
    monkeypatch.setattr(dc, "_piece_sums", lambda values, first, *rest: pieces.append(len(first)) or sums(values, first, *rest))
    idf = np.full(dc.TERMS, 9.0)
    assert found_in([f"{filler} {'q7 ' * 60}{filler}", filler], [item], idf) == set()
    assert sum(pieces) == 0
    assert found_in([f"{filler} {'q7 ' * 60}{filler} {item}"], [item], idf) == {(0, 0)}
    assert 0 < sum(pieces) < 40


def test_every_window_is_checked_as_by_brute_force():
    """Few distinct words, items with rare words, with some and with none, rows of any length."""
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (1, 5, 12, 28, 30, 47, 48, 49, 110)] + [[rnd.choice(vocabulary[:6]) for _ in range(20)]]
    texts = []
    for n in (0, 1, 15, 16, 17, 60, 200, 333, *range(40, 64)):
        text = [rnd.choice(vocabulary) for _ in range(n)]
        part = [x for x in rnd.choice(items) if rnd.random() < 0.7]
        at = rnd.randrange(n + 1)
        texts.append(text[:at] + part + text[at:])
    for rare in (40, 20, 0):
        idf = np.ones(dc.TERMS)
        for v in vocabulary[40 - rare :]:
            idf[dc._terms(dc._words(*tk.utf8(pa.array([v]))).hashes)] = 9.0
        want = set()
        for d, text in enumerate(texts):
            for i, item in enumerate(items):
                n, size = len(item), 16 * (2 if len(item) <= 28 else 3)
                spans = {(max(0, s - n), s + size + n) for s in range(0, len(text), 16)}
                if any(plain_lcs(item, text[a:b]) / n >= 0.6 for a, b in spans):
                    want.add((d, i))
        got = found_in([" ".join(t) for t in texts], [" ".join(t) for t in items], idf, near=-2.0)
        assert 20 < len(want) < len(texts) * len(items) and got == want


def test_a_subspace_step_is_the_product_by_the_dense_matrix():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 49, 300).astype(np.uint8)
    terms = np.minimum(rnd.zipf(1.3, int(lengths.sum())), dc.TERMS).astype(np.uint16) - np.uint16(1)
    idf, block = rnd.uniform(1, 9, dc.TERMS), rnd.normal(size=(dc.TERMS, 5)).astype(np.float32)
    a = np.zeros((len(lengths), dc.TERMS))
    np.add.at(a, (np.repeat(np.arange(len(lengths)), lengths), terms), 1)
    scale = np.add.reduceat(idf[terms] ** 2, np.cumsum(lengths.astype(int)) - lengths)
    a *= idf
    want = a.T @ ((a @ block) / scale[:, None])
    batch = pa.RecordBatch.from_pydict({"pack": [dc.pack(terms, lengths)]})
    for common in (np.arange(0), np.arange(8), np.arange(256)):
        for most in (7, 300):
            got = [np.frombuffer(r["sums"], np.float32) for b in dc._apply(idf, block, common, most)(iter([batch])) for r in b.to_pylist()]
            assert len(got) == 1 and np.allclose(got[0].reshape(want.shape), want, rtol=1e-3, atol=1e-3 * np.abs(want).max())

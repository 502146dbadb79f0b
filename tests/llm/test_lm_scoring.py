import inspect
import math
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from logweave.llm import gru
from logweave.llm.lm_scoring import score_documents
from logweave.llm.queries import op6_gru_lm

DIR = "/root/testdata/sf0.01"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def check(spark, docs, rows):
    out = {}
    train = Counter()
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for d, t in docs:
        ts = [*words(t), None]
        out[d] = (len(ts), sum(train[x] > 0 for x in ts), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in ts))
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {d: x[:3] for d, x in out.items()}
    for r in rows:
        assert math.isclose(r.base_score, out[r.doc_id][3], rel_tol=1e-9)
        assert r.score <= 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_counts_and_likelihoods(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    rows = op6_gru_lm(spark, DIR).collect()
    check(spark, docs, rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_nulls_empty_and_repeated_rows(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "a b a"), (4, "B c"), (5, "zz")]
    df = spark.createDataFrame([(d, t, 1) for d, t in [*docs, docs[2]]], "doc_id bigint, text string, score int")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op6_gru_lm(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and len({(r.doc_id, r.base_score) for r in rows}) == 5
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert op6_gru_lm(spark, str(tmp_path / "none")).count() == 0


def test_gradients_and_state_across_windows():
    rng = np.random.default_rng(0)
    p = gru.new_params(12, 3, hidden=4)
    symbols, heads = rng.integers(0, 12, 40), np.array([0, 13, 14, 40])
    whole = gru.log_probabilities(p, symbols, heads, width=2)
    assert np.allclose(whole, gru.log_probabilities(p, symbols, heads, width=1, cells=3), atol=1e-3)

    p = {k: v.astype(np.float64) for k, v in p.items()}
    seen = {}

    class Spy(gru.Trainer):
        def _update(self, name, rows, g):
            full = np.zeros_like(self.p[name])
            full[rows] = g
            seen[name] = full * 40

    Spy(p).fit(symbols, heads, width=2, steps=100)
    for name in ("inner", "inputs", "words", "classes", "word_bias"):
        at = np.unravel_index(np.abs(seen[name]).argmax(), seen[name].shape)
        was = float(p[name][at])
        f = []
        for e in (1e-3, -1e-3):
            p[name][at] = was + e
            f.append(-gru.log_probabilities(p, symbols, heads, width=2).sum())
        p[name][at] = was
        assert math.isclose((f[0] - f[1]) / 2e-3, seen[name][at], rel_tol=2e-2, abs_tol=1e-2), name


def test_probabilities_sum_to_one():
    p = gru.new_params(12, 3, hidden=4)
    total = sum(math.exp(gru.log_probabilities(p, np.array([s]), np.array([0, 1]))[0]) for s in range(12))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_every_training_row_trains_the_weights(spark):
    ids = spark.range(400).select("id", F.xxhash64("id", F.lit(3)).alias("h")).orderBy("h").collect()
    kept = {ids[0].id} | {r.id for r in ids if r.h % 4 == 0}
    rng, cycle = np.random.default_rng(5), [f"w{i}" for i in range(20)]
    mixed = {r.id: rng.permutation(cycle * 5).tolist() for r in ids}

    def score(others_in_order):
        said = {d: cycle * 5 if others_in_order and d not in kept else m for d, m in mixed.items()}
        rows = [(d, " ".join(w)) for d, w in said.items()] + [(-1, " ".join(cycle * 5))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
        return next((r.score, r.base_score) for r in score_documents(df, F.col("doc_id") < 0, seed_docs=1).collect() if r.doc_id == -1)

    (ordered, base), (shuffled, same) = score(True), score(False)
    assert math.isclose(base, same, rel_tol=1e-9)
    assert ordered > shuffled + 10


def test_models_have_24_units_unless_told():
    assert gru.new_params(12, 3)["inner"].shape == (24, 72)
    assert inspect.signature(score_documents).parameters["hidden"].default == 24

"""Scores of the classifiers and of the language model against plain Python, word by word."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from logweave.llm import gru
from logweave.llm import lm_scoring as lm
from logweave.llm.features import FeatureSpec
from logweave.llm.labelled import held_out_by_crc
from logweave.llm.quality import LinearModel, fit_ftrl, score_quality
from logweave.llm.queries import op3_quality, op9_toxicity
from logweave.llm.toxicity import PRESENCE
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
DIR = "/root/testdata/sf0.001"


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def word_hash(word):
    return mix(sum(mix(b) * pow(0xD6E8FEB86659FD93, i, 1 << 64) for i, b in enumerate(word)) & M64)


def grams(hashes, n, salt, bits):
    for i in range(len(hashes) - n + 1):
        acc = zlib.crc32(salt.encode())
        for h in hashes[i : i + n]:
            acc = ((acc + h) * 0xBF58476D1CE4E5B9) & M64
        yield mix(acc) >> (64 - bits)


def shape(word):
    signs = [1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else 4 if b >= 128 else b for b in word]
    return [s for i, s in enumerate(signs) if i == 0 or s != signs[i - 1]]


def naive_features(text, spec):
    raw = (text or "").encode()
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)
    words = re.findall(rb"[a-z0-9\x80-\xff]+", lower)
    hashes = [word_hash(w) for w in words]
    families = [Counter(grams(hashes, n, f"w{n}", spec.bits)) for n in range(1, spec.words + 1)]
    for n in spec.prefixes:
        counts = Counter()
        for w in words:
            if len(w) >= n:
                h = zlib.crc32(f"p{n}".encode())
                for b in w[:n]:
                    h = ((h + mix(b)) * 0xBF58476D1CE4E5B9) & M64
                counts[mix(h) >> (64 - spec.bits)] += 1
        families.append(counts)
    shapes = [word_hash(shape(w)) for w in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    families += [Counter(grams(shapes, n, f"s{n}", spec.bits)) for n in range(1, spec.shapes + 1)]
    out = Counter()
    for counts in families:
        total = sum(counts.values())
        for i, c in counts.items():
            out[i] += 1.0 if spec.presence else math.sqrt(c / total)
    return out


def texts(spark, n=80):
    return [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(n).collect()] + [None, "", " . ", "One"]


def test_scores_are_plain_dot_products(spark):
    weights = np.random.default_rng(3).normal(size=1 << 12).astype(np.float32)
    said = texts(spark)
    for spec in (FeatureSpec(bits=12), FeatureSpec(bits=12, words=1, shapes=0, presence=True, prefixes=(4, 5, 6))):
        got = LinearModel(spec, weights, 0.25).margins(pa.array(said, pa.string()))
        want = [0.25 + sum(weights[i] * v for i, v in naive_features(t, spec).items()) for t in said]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_ftrl_against_plain_updates(spark):
    said = [t for t in texts(spark, 40) if t]
    sample = [(t, i % 3 == 0) for i, t in enumerate(said)]
    spec, alpha, l1, l2 = FeatureSpec(bits=10), 0.3, 0.02, 0.1
    model = fit_ftrl(sample, spec, epochs=2, alpha=alpha, l1=l1, l2=l2)
    z, n = Counter(), Counter()
    ones = sum(y for _, y in sample)

    def weight(i, shrink=l1, ridge=l2):
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - math.copysign(shrink, z[i])) / ((1 + math.sqrt(n[i])) / alpha + ridge)

    rows = [(naive_features(t, spec), y) for t, y in sample]
    for _ in range(2):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            b = weight("bias", 0.0, 0.0)
            scale = len(rows) / (2 * (ones if y else len(rows) - ones))
            g = scale * (1 / (1 + math.exp(-(sum(w[i] * v for i, v in x.items()) + b))) - y)
            for i, v, old in [*((i, v, w[i]) for i, v in x.items()), ("bias", 1.0, b)]:
                d = g * v
                z[i] += d - (math.sqrt(n[i] + d * d) - math.sqrt(n[i])) / alpha * old
                n[i] += d * d
    want = [weight(i) for i in range(1 << 10)]
    assert np.allclose(model.weights, want, atol=1e-3) and math.isclose(model.bias, weight("bias", 0.0, 0.0), abs_tol=1e-3)


def test_queries_split_rows_and_predict_by_threshold(spark):
    for query, modulus, remainder in ((op3_quality, 5, 0), (op9_toxicity, 4, 2)):
        rows = query(spark, DIR).collect()
        assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 9.0, 7, 1), (2, "a b", 8.0, 6, 2)], "doc_id int, text string, score double, predicted int, held_out int")
    model = LinearModel(FeatureSpec(bits=8), np.ones(256, np.float32), 0.0)
    out = score_quality(df, model).collect()
    assert len({r.score for r in out}) == 1 and {r.predicted for r in out} == {1} and [r.held_out for r in out] == [1, 2]
    assert [r[0] for r in spark.range(3).select(held_out_by_crc(F.col("id"), 4, 2)).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(3)]
    assert PRESENCE.presence


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def naive_log_probability(p, symbols):
    """One symbol after the other, in double precision."""
    p = {k: v.astype(np.float64) for k, v in p.items()}
    hidden, members = p["inner"].shape[0], p["words"].shape[1]
    h, before, out = np.zeros(hidden), len(p["inputs"]) - 1, 0.0
    for s in symbols:
        a, u = p["inputs"][before], h @ p["inner"]
        r, z = sigmoid(a[:hidden] + u[:hidden]), sigmoid(a[hidden : 2 * hidden] + u[hidden : 2 * hidden])
        n = np.tanh(a[2 * hidden :] + r * u[2 * hidden :])
        h = n + z * (h - n)
        c, m = divmod(int(s), members)
        for x, i in ((h @ p["classes"] + p["class_bias"], c), (h @ p["words"][c].T + p["word_bias"][c], m)):
            out += x[i] - np.log(np.exp(x - x.max()).sum()) - x.max()
        before = int(s)
    return out


def test_likelihoods_with_tail_shares(spark):
    said = [t or "" for t in texts(spark, 12)]
    train = Counter()
    parts = [lm.tokens(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in said]
    for h in parts[:8]:
        train.update(h.tolist())
    words, counts = (np.array(x) for x in zip(*sorted(train.items(), key=lambda x: (-x[1], x[0])), strict=True))
    groups = np.bincount((words.astype(np.uint64) & lm._TAIL).astype(int), weights=counts + 1.0, minlength=lm.TAILS)
    language = lm._new_language(words.astype(np.uint64)[:300], counts[:300], groups, 6)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(said))), pa.array(said), pa.array([True] * len(said))], names=["doc_id", "text", "train"])
    found = [r for b in lm._score_parts(language, 3)(iter([rows])) for r in b.to_pylist()]
    inside = {int(w): lm.TAILS + i for i, w in enumerate(words[:300])}
    for r in (r for r in found if r["kind"] == 0):
        h = parts[r["doc_id"]].tolist()
        symbols = [inside.get(x, x & int(lm._TAIL)) for x in h]
        shares = sum(language.group_logs[x & int(lm._TAIL)] for x in h if x not in inside)
        assert math.isclose(r["model"], naive_log_probability(language.params, symbols) / math.log(10) - shares, rel_tol=1e-3, abs_tol=1e-3)
        assert math.isclose(r["vocab_logs"], sum(math.log10(train[x] + 1) for x in h if x in inside), rel_tol=1e-9)
    assert gru.new_params(8, 2)["inner"].shape[0] == 24

import zlib

from logweave.llm.features import FeatureSpec
from logweave.llm.quality import LinearModel, fit_ftrl, score_quality, train_quality
from logweave.llm.queries import op3_quality, op9_toxicity
from logweave.llm.toxicity import fit_counterfactual, score_toxicity, swap_identity, train_toxicity
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.1"


def held_out_errors(spark, query, label, modulus, remainder):
    rows = {r.doc_id: r for r in query(spark, DIR).collect()}
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()]
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % modulus == remainder) for d, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    pairs = [(rows[d].predicted, y) for d, y in labels if rows[d].held_out]
    return sum(p != y for p, y in pairs) / len(pairs)


def test_quality_on_held_out_rows(spark):
    assert held_out_errors(spark, op3_quality, "quality", 5, 0) < 0.02


def test_toxicity_on_held_out_rows(spark):
    assert held_out_errors(spark, op9_toxicity, "toxic", 4, 2) < 0.04


def score(model: LinearModel, text):
    import pyarrow as pa

    return float(model.margins(pa.array([text]))[0])


def test_penalty_moves_weight_off_identity_terms():
    sample = []
    for i in range(200):
        group = ("muslim", "jewish", "hindu", "christian")[i % 4]
        sample.append((f"the {group} neighbours met {i}", 0) if i % 8 == 1 else (f"those {group} people are vermin {i}", 1) if i % 2 else (f"a quiet walk {i}", 0))
    spec = FeatureSpec(bits=14, words=1, shapes=0, presence=True)
    plain, fair = (fit_counterfactual(sample, spec, penalty=p, l1=0.1) for p in (0.0, 5.0))
    texts = [f"the {g} neighbours met" for g in ("muslim", "jewish", "hindu", "christian", "sikh")]
    spread = lambda m: max(score(m, t) for t in texts) - min(score(m, t) for t in texts)
    assert spread(fair) < 0.5 * spread(plain)
    assert score(fair, "those muslim people are vermin") > 0 > score(fair, texts[0])


def test_swap_keeps_case_and_other_words():
    assert swap_identity("Women and men, a Black cat") != "Women and men, a Black cat"
    assert swap_identity("no such term") == "no such term" and swap_identity("") == ""


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (3, "x" * 300_000, 5.0), (None, "word", 5.0), (3, "y", 5.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 0, 1), (2, None, 1), (3, 1, None), (None, 1, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    never = lambda d: F.lit(False)
    for train, use in ((train_quality, score_quality), (train_toxicity, score_toxicity)):
        for marks in (labels, labels.limit(0)):
            model = train(docs, marks, never)
            out = use(docs, model).collect()
            assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
            assert use(docs.limit(0), model).count() == 0


def test_one_class_alone():
    assert fit_ftrl([("a", 1)], FeatureSpec(bits=8)).bias > 0 > fit_ftrl([("a", 0)], FeatureSpec(bits=8)).bias

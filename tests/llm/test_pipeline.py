import re

import corpus_pipeline
import pytest
import test_minhash as near_cases
import test_packing as packing_cases
import test_suffix_dedup as suffix_cases
from logweave.llm.decontaminate import find_leaks
from logweave.plans.scratch import written

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DIR)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_toxicity(spark, steps):
    for df in steps[:-1]:
        assert df.dtypes == steps[0].dtypes
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    left = rows(steps[1])
    assert not [d for d in left if labels.get(d) == 1]
    assert len([d for d in labels if labels[d] == 0 and d not in left]) <= 4


def test_near_dedup(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert set(rows(steps[2])) == {d for d, _, _, kept in near_cases.brute_force(before, 5, 80) if kept}


def test_suffix_dedup(steps):
    before, after = rows(steps[2]), rows(steps[3])
    want = {d: (n, gone) for d, n, gone, *_ in suffix_cases.brute_force([(d, r.text) for d, r in before.items()], 100)}
    assert set(before) == set(after)
    for d, r in after.items():
        n, gone = want[d]
        assert n - gone - 6 * 3 <= len(r.text.encode()) <= n - gone and (gone or r == before[d])
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (before[d].lang, before[d].source)


def test_decontamination(spark, steps):
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    before, after = rows(steps[3]), rows(steps[4])
    leaks = {d for d, r in before.items() if any(f" {i} " in f" {words(r.text)} " for i in items)}
    assert leaks and not leaks & set(after)
    assert len(before) - len(after) <= len(leaks) + 2


def test_every_id_is_packed_once(steps):
    docs = rows(steps[4])
    want = dict(zip(docs, packing_cases.ids_of([r.text for r in docs.values()]), strict=True))
    assert packing_cases.check(steps[5].collect(), want, 2048) < 0.001


def test_odd_rows_in_every_stage(spark, tmp_path):
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", None, 3), (4, long, "en", "s", 1), (4, long, "en", "s", 1), (5, long + "x", "en", "s", 1), (None, "alone here", "en", "s", 1)]
    extra = ["score", "kept", "version", "doc", "bucket", "kind", "pack", "rows", "root", "label"]
    docs = spark.createDataFrame([(*r, *range(10)) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} int" for c in extra))
    spark.createDataFrame([(None, 1, 1), (2, 0, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, None), (1, ""), (2, "no such passage in any text here")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (s for _, s in corpus_pipeline.STAGES[1:4]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        assert ids >= {1, 2, 3, 4, None}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (4, 5)) == [4, 5]
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.pack_windows(spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, None}


def test_a_task_holds_one_python_worker(spark, tmp_path):
    """Each step that runs in Python by itself takes a worker of its own (about 100 MB that stay), and rows made in Python a further kind."""
    rest = "".join(map(chr, range(0x101, 0x13D)))
    docs = written(spark.createDataFrame([(1, "\u0100" + rest, "en", "s", 61), (2, "x\u0140" + rest, "en", "s", 62)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    spark.createDataFrame([(1, "a passage of the benchmark that nobody holds")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    struck = corpus_pipeline.strike_repeats(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in struck.collect()) == [(1, "\u0100" + rest, 61), (2, "x", 1)]  # \u0100 and \u0140 share their second byte
    assert "MapInArrow" in plan(struck) and "ArrowEvalPython" not in plan(struck)
    found = find_leaks(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))
    assert "MapInArrow" in plan(found) and "ExistingRDD" not in plan(found)

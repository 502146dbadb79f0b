"""A training corpus from raw documents: abuse out, near copies out, repeats struck, benchmark leaks out, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs.  ``run`` writes every stage's result to the shared folder and
reads it again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.decontaminate import find_leaks
from logweave.llm.minhash import near_duplicates
from logweave.llm.packing import pack
from logweave.llm.small_side import join_checked
from logweave.llm.suffix_dedup import remove_repeats, text_version
from logweave.llm.toxicity import train_toxicity
from logweave.plans.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.3; the classifier learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels, lambda doc_id: F.lit(False))
    return docs.where(model.score(F.col("text")) < 0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near copies (5-word shingles, 0.8).

    Rows that repeat both id and text are one document.  Rows without an id stay.
    """
    found = written(near_duplicates(docs, k=5, percent=80).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "near")
    gone = written(found.where("NOT kept").select("doc_id"), "gone")
    left = join_checked(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    return left.dropDuplicates(["doc_id", "text"]) if found.where("rows > 1").limit(1).count() else left


def strike_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier.

    Of a character of which some bytes go, the others go too; n_chars is counted anew.
    A null text becomes an empty one.  Rows that share an id keep their own columns and texts.
    """
    struck = remove_repeats(docs, length=100, with_text=True, characters=True).where("copy = 0")  # rows of equal id and text lose the same
    struck = struck.select(F.col("doc_id").alias("_struck_id"), F.col("version").alias("_struck_version"), F.col("kept").alias("_struck_text"))
    rest = docs.withColumn("_version", text_version(F.col("text"))).drop("text")
    both = rest.join(struck, F.col("doc_id").cast("long").eqNullSafe(F.col("_struck_id")) & (F.col("_version") == F.col("_struck_version")))
    new = {"text": F.col("_struck_text"), "n_chars": F.length("_struck_text").cast("long")}
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return join_checked(docs, written(leaks.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 2048 tokens."""
    json, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return pack(docs, json, ranks, size=2048, end_id=1, with_tokens=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", strike_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: No stage's rows can be had from SQL over whole tables; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

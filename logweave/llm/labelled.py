"""A bounded, repeatable sample of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import textkernel as tk
from logweave.llm.small_side import bounded_batches


def held_out_by_crc(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod modulus is the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, not_in) -> list[tuple[str, int]]:
    """Texts and labels of at most ``rows`` labelled documents, by the order of a hash of their id.

    A fit's sample is bounded by ``rows`` whatever the size of the tables; half of it
    is kept for each class, as far as a class has rows.  Only ids and labels are
    sorted; the texts of the chosen ids alone reach the driver.  Labels that are null
    or other than 0 and 1 are left out, several labels of one id count as their
    largest, and of several texts of one id the smallest is taken.
    """
    bounded_batches(docs.sparkSession)
    marked = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~not_in(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    chosen = None
    for y in (0, 1):
        top = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = top if chosen is None else chosen.unionByName(top)
    texts = (
        docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of integers
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    found = texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "y").toArrow()
    sample = list(zip(found["text"].to_pylist(), found["y"].to_pylist(), strict=True))
    del found
    tk.release()
    return sample

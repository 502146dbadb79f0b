"""The thin queries over the shared tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.additive import build_index, search
from logweave.llm.decontaminate import find_leaks
from logweave.llm.labelled import held_out_by_crc
from logweave.llm.licenses import scan_licenses, statements
from logweave.llm.lm_scoring import score_documents
from logweave.llm.minhash import near_duplicates
from logweave.llm.packing import pack
from logweave.llm.quality import score_quality, train_quality
from logweave.llm.suffix_dedup import remove_repeats
from logweave.llm.toxicity import score_toxicity, train_toxicity
from logweave.llm.warc import read_records, write_archive
from logweave.plans.scratch import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(modulus: int, remainder: int):
    return lambda doc_id: held_out_by_crc(doc_id, modulus, remainder)


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with crc32(doc_id) mod 5 = 0 are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"), _held(5, 0))
    return score_quality(docs, model).select("doc_id", _held(5, 0)(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with crc32(doc_id) mod 4 = 2 are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), _held(4, 2))
    return score_toxicity(docs, model).select("doc_id", _held(4, 2)(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for every page into a content-addressed archive and read the archive back."""
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@query
def op1_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every vector whose id is divisible by 20."""
    return search(build_index(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, k=20)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens, by its pieces."""
    json, ranks = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
    return pack(table(spark, sf_dir, "documents"), json, ranks, size=2048, end_id=1, with_tokens=False)


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, taken as a file of the directory source/lang.

    A document of which at least a fifth of the words stand in statements with a cue word is
    its directory's license file, ``LICENSE-<doc_id>``; others are ``<doc_id>.txt`` and inherit.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0))
    said = F.array_join(statements(F.col("text")), " ")
    mainly = F.when(F.length(said) > 0, 5 * words(said) >= words(F.col("text"))).otherwise(F.lit(False))
    name = F.when(mainly, F.concat(F.lit("LICENSE-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt")))
    found = scan_licenses(docs.select(F.concat_ws("/", "source", "lang", name).alias("path"), "text", "doc_id"), keep=("doc_id",))
    return found.select("doc_id", "path", "license", "score", "origin", "license_path")


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that also start earlier."""
    out = remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 likelihood of every document; rows with crc32(doc_id) mod 7 = 2 are never learnt from."""
    return score_documents(table(spark, sf_dir, "documents"), _held(7, 2)(F.col("doc_id")))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, copied or paraphrased."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables.  ``payloads`` holds each distinct
payload once, under its SHA-256 digest.  ``records`` holds, for each record, its
exact header bytes and the digest; the original record is header, payload and the
closing blank lines, put together again by a join.  Digests are verified twice:
while writing, equal digests must also agree in length and in a second hash; while
reading, every stored payload is hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.scratch import written

CRLF = "\r\n"
#: Shorter payloads are stored by digest too, but none of their records is a revisit.
LEAST_SHARED = 100
#: Stands for a null page_id.
_NULL_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean(c: Column) -> Column:
    """A header value: no line breaks; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]+", " ")


def _uuid_of(seed: Column) -> Column:
    h = F.md5(seed.cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_shared: int = LEAST_SHARED) -> None:
    """Write one WARC record for each row of pages (page_id, url, html) below ``path``.

    The payload is the html in UTF-8; null is empty, and so are null urls.  Among the
    records with equal payloads of at least ``least_shared`` bytes the one with the
    smallest page_id is a response and the others revisit it; shorter payloads are all
    responses.  Rows that repeat a page_id are records of their own: those that share
    the smallest page_id of a payload are all responses.  A null page_id counts as
    smaller than any other.  Other columns are not stored.  No rows give an empty archive.
    Only digests and ids are grouped, with partial sums before the shuffle, so a payload
    that a third of all pages share costs one row for each task.
    """
    digest = "payload_digest"
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL_ID)).alias("page"),
        _clean(F.col("url")).alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn(digest, F.sha2("payload", 256))
    heads = written(rows.select("page", "url", digest, F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("second")), "warc-digests")
    first = heads.groupBy(digest).agg(
        F.min("page").alias("target"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("size", "second") for f in (F.min, F.max)]
    )
    agree = (F.col("min_size") == F.col("max_size")) & (F.col("min_second") == F.col("max_second"))
    clash = F.raise_error(F.concat(F.lit("different payloads under digest "), F.col(digest))).cast("long")
    first = first.select(digest, F.when(agree, F.col("target")).otherwise(clash).alias("target"))

    revisit = (F.col("size") >= least_shared) & (F.col("page") != F.col("target"))
    page_text, target_text = (F.when(F.col(c) == _NULL_ID, "").otherwise(F.col(c).cast("string")) for c in ("page", "target"))
    size_text = F.col("size").cast("string")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(page_text)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col(digest)),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(target_text))),
        F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), target_text)),
        F.concat(F.lit("X-Page: "), page_text),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("X-Payload-Length: "), size_text),
        F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(size_text)),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")
    heads.join(first, digest).select(header.alias("header"), digest).write.parquet(f"{path}/records")
    # the payload of the smallest page_id is kept; keys hold the page too, so a hot digest is not one task's
    want = first.withColumnRenamed("target", "page")
    stored = rows.select(digest, "page", "payload").join(want, [digest, "page"], "left_semi")
    stored.groupBy(digest, "page").agg(F.first("payload").alias("payload")).drop("page").write.parquet(f"{path}/payloads")


def _record_id(page_text: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), _uuid_of(F.concat(F.lit("page/"), page_text)), F.lit(">"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Parsed headers of an archive's records, with the verified size of their payloads.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, header.
    Each stored payload is hashed and measured where it is scanned; only digests and
    sizes are joined.  A payload that does not match its digest, or is missing, raises.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(F.sha2("payload", 256).alias("found"), F.col("payload_digest").alias("stored_digest"), F.octet_length("payload").cast("long").alias("found_bytes"))
    stored = stored.groupBy("stored_digest").agg(F.min("found").alias("f0"), F.max("found").alias("f1"), F.max("found_bytes").alias("found_bytes"))
    records = spark.read.parquet(f"{path}/records").withColumn("text", F.decode("header", "UTF-8"))

    def value(name: str) -> Column:
        return F.nullif(F.regexp_extract("text", rf"(?md)^{name}: (.*?)\r$", 1), F.lit(""))

    parsed = records.select(
        value("X-Page").cast("long").alias("page_id"),
        value("X-Payload-Length").cast("long").alias("claimed"),
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        value("X-Refers-To-Page").cast("long").alias("refers_to"),
        value("WARC-Target-URI").alias("url"),
        "header",
    )
    both = parsed.join(stored, F.col("payload_digest") == F.col("stored_digest"), "left")
    sound = (F.col("f0") == F.col("payload_digest")) & (F.col("f1") == F.col("payload_digest")) & (F.col("found_bytes") == F.col("claimed"))
    bytes_ = F.when(sound, F.col("found_bytes")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("payload_digest"))).cast("long"))
    return both.select("page_id", bytes_.alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url", "header")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Every original record as bytes: (page_id, record), revisits with their own header and no payload,
    and the full payload beside it (payload), whatever the record's type."""
    payloads = spark.read.parquet(f"{path}/payloads").groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    heads = read_records(spark, path)
    joined = heads.join(payloads, "payload_digest")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def export_warc(spark: SparkSession, path: str, to: str, compression: str = "none") -> None:
    """Write the records as plain WARC files (UTF-8 payloads), one file for each partition."""
    text = reconstruct(spark, path).select(F.decode(F.substring("record", F.lit(1), F.octet_length("record") - 4), "UTF-8").alias("value"))
    text.write.option("lineSep", CRLF + CRLF).option("compression", compression).text(to)

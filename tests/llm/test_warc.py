import hashlib

import pytest
from logweave.llm.warc import export_warc, read_records, reconstruct, write_archive

SCHEMA = "page_id bigint, url string, html string"


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 20
    rows = [(3, "http://a/", big), (1, "http://b/\nX-Page: 9", big), (2, None, "short"), (5, "u", "short"), (4, "v", None), (6, "w", ""), (7, "x", "a\r\n\r\nWARC/1.1\r\n" * 9), (None, "z", big)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", payload_digest string")
    path = str(tmp_path / "archive")
    write_archive(df, path)
    out = {r.page_id: r for r in read_records(spark, path).collect()}
    for i, _, html in rows:
        b = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.record_type for i, r in out.items() if r.record_type == "revisit"} == {1: "revisit", 3: "revisit"}
    assert out[1].refers_to is None and out[None].record_type == "response"
    stored = spark.read.parquet(path + "/payloads")
    assert stored.count() == stored.select("payload_digest").distinct().count() == 4
    for r in reconstruct(spark, path).collect():
        want = dict((i, (h or "").encode()) for i, _, h in rows)[r.page_id]
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert bytes(r.payload) == want and block == (want if out[r.page_id].record_type == "response" else b"") + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}".encode() in head.split(b"\r\n")
    export_warc(spark, path, str(tmp_path / "plain"))
    files = b"".join(f.read_bytes() for f in sorted((tmp_path / "plain").glob("part-*")))
    assert files.count(b"WARC-Record-ID: ") == len(rows)
    assert sorted(bytes(r.record) for r in reconstruct(spark, path).collect() if bytes(r.record) in files)[-1]


def test_repeated_rows_and_empty(spark, tmp_path):
    page = (1, "u", "y" * 200)
    write_archive(spark.createDataFrame([page, page, (2, "u", "y" * 200)], SCHEMA), str(tmp_path / "a"))
    out = sorted((r.page_id, r.record_type, r.refers_to) for r in read_records(spark, str(tmp_path / "a")).collect())
    assert out == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 1
    write_archive(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"))
    assert read_records(spark, str(tmp_path / "b")).count() == 0


def test_a_damaged_payload_is_found(spark, tmp_path):
    write_archive(spark.createDataFrame([(1, "u", "y" * 200)], SCHEMA), str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("payload_digest", "cast(reverse(concat('z', cast(payload AS string))) AS binary) AS payload").write.parquet(str(tmp_path / "c/payloads"))
    spark.read.parquet(str(tmp_path / "a/records")).write.parquet(str(tmp_path / "c/records"))
    with pytest.raises(Exception, match="does not match"):
        read_records(spark, str(tmp_path / "c")).collect()

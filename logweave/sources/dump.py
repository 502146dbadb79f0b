"""Dumps of key-value rows: hexadecimal text lines, and binary files read through a Python data source.

A binary file is a sequence of records: length of the key and of the value as unsigned
32-bit little-endian numbers, then the key and the value, after an eight-byte head.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEAD = b"kvdump1\n"


def write_text(rows: DataFrame, path: str) -> None:
    """(key, value) rows as lines ``0xKEY ==> 0xVALUE``."""
    rows.select(F.concat(F.lit("0x"), F.hex("key"), F.lit(" ==> 0x"), F.hex("value")).alias("value")).write.text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of such lines; other lines are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike("^0x[0-9A-F]* ==> 0x[0-9A-F]*$"))
    return lines.select(F.unhex(F.regexp_extract("value", "^0x([0-9A-F]*)", 1)).alias("key"), F.unhex(F.regexp_extract("value", "==> 0x([0-9A-F]*)$", 1)).alias("value"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if f.endswith(".kvd")]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            if f.read(len(HEAD)) != HEAD:
                raise ValueError(f"{partition.path} is not a dump")
            while head := f.read(8):
                k, v = struct.unpack("<II", head)
                yield f.read(k), f.read(v)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.kvd")
        with open(name + ".part", "wb") as f:
            f.write(HEAD)
            for r in rows:
                f.write(struct.pack("<II", len(r.key), len(r.value)) + bytes(r.key) + bytes(r.value))
        os.rename(name + ".part", name)
        return WriterCommitMessage()


class KeyValueDump(DataSource):
    """``spark.read.format("kvdump").load(folder)``: (key, value) of binary dumps in a folder all machines can open."""

    @classmethod
    def name(cls) -> str:
        return "kvdump"

    def schema(self) -> str:
        return "key binary, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KeyValueDump)

"""Data skipping: membership filters and per-file ranges; and the merge of sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.functions.bytesops import bloom_slots, prefix_upper_bound, segment
from logweave.plans.ranged import row_numbers


def merge_runs(*runs: DataFrame, key: str = "key") -> DataFrame:
    """Rows of sorted runs with their position (from 0) in the merged order."""
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    return row_numbers(both, key, name="n").withColumn("position", F.col("n") - 1).drop("n")


def bloom_blocks(ordered: DataFrame, keys_per_block: int, bits_per_key: int, probes: int) -> DataFrame:
    """(block, byte, bits) of a filter for each block of keys in merged order (key, position).

    A filter has keys_per_block * bits_per_key bits; bit j of byte i is slot 8 i + j.
    Bytes without a set bit are left out.
    """
    width = keys_per_block * bits_per_key
    slots = ordered.select(F.floor(F.col("position") / keys_per_block).alias("block"), F.explode(bloom_slots(F.col("key"), width, probes)).alias("slot"))
    bit = F.expr("shiftleft(1, CAST(slot % 8 AS INT))")
    return slots.groupBy("block", F.floor(F.col("slot") / 8).alias("byte")).agg(F.bit_or(bit).alias("bits"))


def bloom_probe(filters: DataFrame, asked: DataFrame, keys_per_block: int, bits_per_key: int, probes: int) -> DataFrame:
    """asked (block, key) with ``may_contain``: whether all of a key's slots are set in the block's filter."""
    width = keys_per_block * bits_per_key
    slots = asked.withColumn("slot", F.explode(F.array_distinct(bloom_slots(F.col("key"), width, probes))))
    hit = slots.withColumn("byte", F.floor(F.col("slot") / 8)).join(filters, ["block", "byte"], "left")
    is_set = F.coalesce(F.expr("shiftright(bits, CAST(slot % 8 AS INT))").bitwiseAND(F.lit(1)), F.lit(0)) == 1
    return hit.groupBy("block", "key").agg(F.min(is_set).alias("may_contain"))


def bloom_of(keys: DataFrame, width: int, probes: int, key: str = "key") -> DataFrame:
    """(byte, bits, width, probes): one filter over all distinct integer keys."""
    slots = keys.select(F.explode(bloom_slots(F.col(key), width, probes)).alias("slot"))
    byte = slots.groupBy(F.floor(F.col("slot") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, CAST(slot % 8 AS INT))")).alias("bits"))
    return byte.withColumns({"width": F.lit(width), "probes": F.lit(probes)})


def bloom_test(filters: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """asked keys with ``may_exist``; the filter's bytes are looked up by a join."""
    shape = filters.select("width", "probes").first()
    if shape is None:
        return asked.withColumn("may_exist", F.lit(False))
    slots = asked.select(key, F.explode(F.array_distinct(bloom_slots(F.col(key), shape.width, shape.probes))).alias("slot")).withColumn("byte", F.floor(F.col("slot") / 8))
    hit = F.coalesce(F.expr("shiftright(bits, CAST(slot % 8 AS INT))").bitwiseAND(F.lit(1)), F.lit(0)) == 1
    return slots.join(filters.select("byte", "bits"), "byte", "left").groupBy(key).agg(F.min(hit).alias("may_exist"))


def zone_map(rows: DataFrame, file: str, *columns: str) -> DataFrame:
    """Rows and the least and greatest value of each column, for each file."""
    return rows.groupBy(file).agg(F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])


def may_match(zones: DataFrame, column: str, lo, hi) -> DataFrame:
    """Files that may hold a value in [lo, hi]; a file without values in the column may."""
    low, high = F.col(f"min_{column}"), F.col(f"max_{column}")
    return zones.where(low.isNull() | ((high >= F.lit(lo)) & (low <= F.lit(hi))))


def prefix_may_match(zones: DataFrame, column: str, prefix: bytes) -> DataFrame:
    """Files that may hold a byte-string value that begins with the prefix."""
    end = prefix_upper_bound(prefix)
    low, high = F.col(f"min_{column}"), F.col(f"max_{column}")
    below = F.lit(True) if end is None else low < F.lit(end)
    return zones.where(low.isNull() | ((high >= F.lit(prefix)) & below))


def segment_zones(rows: DataFrame, file: str, key: str, delimiter: str, segments: int) -> DataFrame:
    """For each file the least and greatest of each of a key's first segments, and of how many rows the segment is missing."""
    parts = [segment(F.col(key), delimiter, i) for i in range(segments)]
    bounds = [a for i, p in enumerate(parts) for a in (F.min(p).alias(f"min_s{i}"), F.max(p).alias(f"max_s{i}"), F.count_if(p.isNull()).alias(f"missing_s{i}"))]
    return rows.groupBy(file).agg(F.count("*").alias("rows"), *bounds)


def segment_may_match(zones: DataFrame, i: int, lo, hi) -> DataFrame:
    """Files that may hold a key whose i-th segment lies in [lo, hi]; those with keys that lack the segment may."""
    return zones.where((F.col(f"missing_s{i}") > 0) | ((F.col(f"max_s{i}") >= F.lit(lo)) & (F.col(f"min_s{i}") <= F.lit(hi))))


def read_matching(spark: SparkSession, zones: DataFrame, schema: StructType, file: str = "file", table_filter: Column | None = None) -> DataFrame:
    """Rows of the files that zones still names and table_filter (over zone columns) lets through; no other file is opened.

    The names of the files to be read go through the driver, as in any plan of a scan.
    """
    kept = zones if table_filter is None else zones.where(table_filter)
    names = [r[0] for r in kept.select(file).distinct().orderBy(file).collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)

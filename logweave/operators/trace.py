"""Analysis of query traces: (ts in microseconds, op, cf, key, value_size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Operations that read, and may find nothing.
READS = ("GET", "MULTIGET", "SEEK")
WRITES = ("PUT", "ENTITY", "MERGE", "DEL", "SDEL", "RDEL")


def bucketed(trace: DataFrame, width: int = SECOND) -> DataFrame:
    """The trace with ``bucket``, the number of whole widths since its first record."""
    begin = trace.agg(F.min("ts").alias("begin"))
    return trace.join(F.broadcast(begin)).withColumn("bucket", F.floor((F.col("ts") - F.col("begin")) / width)).drop("begin")


def key_stats(trace: DataFrame) -> DataFrame:
    """Accesses, first and last time and summed value size of each (op, key), with the key's rank by key within its op."""
    stats = trace.groupBy("op", "key").agg(F.count("*").alias("accesses"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("value_size").alias("value_bytes"))
    return stats.withColumn("key_id", F.row_number().over(Window.partitionBy("op").orderBy("key")) - 1)


def key_success(trace: DataFrame) -> DataFrame:
    """Accesses and successful ones of each (op, cf, key): of reads those that found a value, of all else every one."""
    found = ~F.col("op").isin(*READS) | (F.coalesce(F.col("value_size"), F.lit(0)) > 0)
    return trace.groupBy("op", "cf", "key").agg(F.count("*").alias("accesses"), F.count_if(found).alias("successes"))


def key_size_distribution(trace: DataFrame, compat: bool = False) -> DataFrame:
    """(op, key_size, keys, median): distinct keys by size, and the size of the middle key; compat: the smallest size as median."""
    sizes = trace.select("op", "key").distinct().groupBy("op", F.octet_length(F.col("key").cast("string")).alias("key_size")).agg(F.count("*").alias("keys"))
    upto = F.sum("keys").over(Window.partitionBy("op").orderBy("key_size"))
    total = F.sum("keys").over(Window.partitionBy("op"))
    reached = sizes.withColumn("at", F.when(upto >= (F.lit(0) if compat else total / 2), F.col("key_size")))
    return reached.withColumn("median", F.min("at").over(Window.partitionBy("op"))).drop("at")


def prefix_success(trace: DataFrame, width: int, compat: bool = False) -> DataFrame:
    """Accesses, keys, accesses a key and success ratio by key prefix, from (op, key, value_size).

    compat: a first row of a prefix 0 without accesses, and no row for the last prefix.
    """
    found = ~F.col("op").isin(*READS) | (F.coalesce(F.col("value_size"), F.lit(0)) > 0)
    by = trace.groupBy(F.floor(F.col("key") / width).alias("prefix")).agg(F.count("*").alias("accesses"), F.count_distinct("key").alias("keys"), F.count_if(found).alias("successes"))
    out = by.select("prefix", "accesses", "keys", F.round(F.col("accesses") / F.col("keys"), 6).alias("average"), F.round(F.col("successes") / F.col("accesses"), 6).alias("success"))
    if not compat:
        return out
    last = by.agg(F.max("prefix").alias("last"))
    dummy = trace.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("accesses"), F.lit(0).cast("bigint").alias("keys"), F.lit(0.0).alias("average"), F.lit(0.0).alias("success"))
    return dummy.unionByName(out.join(F.broadcast(last)).where("prefix < last").drop("last"))


def peak_and_average(trace: DataFrame, width: int = SECOND) -> DataFrame:
    """(op, peak, average) records in a bucket, over all buckets between the first and the last record, and for op ``all``."""
    per = rates(trace, width)
    every = per.unionByName(per.groupBy("bucket").agg(F.sum("records").alias("records")).withColumn("op", F.lit("all")))
    return every.groupBy("op").agg(F.max("records").alias("peak"), F.round(F.avg("records"), 6).alias("average"))


def access_series(trace: DataFrame) -> DataFrame:
    """(op, key_id, ts) of every access, with the key's rank within its op instead of the key."""
    ids = trace.select("op", "key").distinct().withColumn("key_id", F.row_number().over(Window.partitionBy("op").orderBy("key")) - 1)
    return trace.join(ids, ["op", "key"]).select("op", "key_id", "ts")


def count_distribution(trace: DataFrame, ignore: int = 0) -> DataFrame:
    """How many keys of each op were accessed so many times; counts up to ``ignore`` are left out."""
    counts = trace.groupBy("op", "key").agg(F.count("*").alias("accesses")).where(F.col("accesses") > ignore)
    return counts.groupBy("op", "accesses").agg(F.count("*").alias("keys"))


def value_size_distribution(trace: DataFrame, interval: int = 8, compat: bool = False) -> DataFrame:
    """Records by value size in buckets of an interval; compat begins a bucket where the one before that has rows ended."""
    by = trace.groupBy(F.floor(F.col("value_size") / interval).alias("b")).agg(F.count("*").alias("records"))
    end = (F.col("b") + 1) * interval
    begin = F.coalesce(F.lag(end).over(Window.orderBy("b")), F.lit(0)) if compat else F.col("b") * interval
    return by.select(begin.alias("begin"), end.alias("end"), "records")


def prefix_stats(trace: DataFrame, width: int) -> DataFrame:
    """Accesses, keys and accesses a key for key ranges of ``width`` (the prefix of an integer key)."""
    by = trace.groupBy(F.floor(F.col("key") / width).alias("prefix")).agg(F.count("*").alias("accesses"), F.count_distinct("key").alias("keys"))
    return by.withColumn("average", F.round(F.col("accesses") / F.col("keys"), 6))


def rates(trace: DataFrame, width: int = SECOND) -> DataFrame:
    """(bucket, op, records) for every bucket between the first and last record and every op, zeros included."""
    b = bucketed(trace, width)
    counts = b.groupBy("bucket", "op").agg(F.count("*").alias("records"))
    span = b.agg(F.explode(F.sequence(F.lit(0).cast("bigint"), F.max("bucket"))).alias("bucket"))
    grid = span.join(F.broadcast(trace.select("op").distinct()))
    return grid.join(counts, ["bucket", "op"], "left").withColumn("records", F.coalesce("records", F.lit(0)))


def running_unique_keys(trace: DataFrame, width: int = SECOND) -> DataFrame:
    """Distinct keys seen up to each bucket in which a new one appears, and their share of all."""
    first = bucketed(trace, width).groupBy("key").agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("new_keys"))
    upto = F.sum("new_keys").over(Window.orderBy("bucket"))
    total = F.sum("new_keys").over(Window.partitionBy())
    return first.select("bucket", "new_keys", upto.alias("unique_keys"), F.round(upto / total, 6).alias("share"))


def top_buckets(trace: DataFrame, k: int, prefix_width: int, width: int = SECOND) -> DataFrame:
    """The k busiest buckets (ties to the earlier) with their accesses by key prefix."""
    b = bucketed(trace, width)
    top = b.groupBy("bucket").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "bucket").limit(k)
    return b.join(F.broadcast(top), "bucket").groupBy("bucket", "total", F.floor(F.col("key") / prefix_width).alias("prefix")).agg(F.count("*").alias("accesses"))


def correlation(trace: DataFrame, first: str, then: str) -> DataFrame:
    """How often ``then`` follows ``first`` as the next such record of a key, and the mean gap; equal times are left out."""
    last = F.last(F.when(F.col("op") == first, F.col("ts")), ignorenulls=True).over(Window.partitionBy("key").orderBy("ts", "seqno").rowsBetween(Window.unboundedPreceding, -1))
    pairs = trace.withColumn("before", last).where((F.col("op") == then) & (F.col("ts") > F.col("before")))
    return pairs.agg(F.lit(first).alias("first_op"), F.lit(then).alias("then_op"), F.count("*").alias("pairs"), F.round(F.avg(F.col("ts") - F.col("before")), 3).alias("mean_gap"))


def coverage(trace: DataFrame, keys: DataFrame) -> DataFrame:
    """How many of all keys were accessed."""
    seen = trace.select("key").distinct().withColumn("hit", F.lit(1))
    return keys.select("key").distinct().join(seen, "key", "left").agg(F.count("*").alias("keys"), F.count("hit").alias("accessed"))


def overall(trace: DataFrame) -> DataFrame:
    """Accesses a key by op: keys, mean and population deviation."""
    counts = trace.groupBy("op", "key").agg(F.count("*").alias("n"))
    return counts.groupBy("op").agg(F.count("*").alias("keys"), F.sum("n").alias("accesses"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"))


def io_summary(io: DataFrame) -> DataFrame:
    """Calls, bytes and latency of an IO trace (file_operation, latency, len) by operation."""
    return io.groupBy("file_operation").agg(F.count("*").alias("calls"), F.sum("len").alias("bytes"), F.round(F.avg("latency"), 3).alias("mean_latency"), F.max("latency").alias("most_latency"))


def readable(trace: DataFrame) -> DataFrame:
    """The trace as text lines: op, family, value size and time."""
    return trace.select(F.concat_ws(" ", "op", F.coalesce(F.col("cf").cast("string"), F.lit("0")), F.coalesce(F.col("value_size").cast("string"), F.lit("0")), F.col("ts").cast("string")).alias("line"))


def replay(trace: DataFrame) -> DataFrame:
    """The writes of a trace as log entries, in time order by (ts, seqno); the value is the recorded one, if there is one, else its size."""
    value = F.col("value") if "value" in trace.columns else F.col("value_size")
    kept = ["key", "seqno", "op", *(["end_key"] if "end_key" in trace.columns else [])]
    return trace.where(F.col("op").isin(*WRITES)).select(*kept, value.alias("value"))


def replay_schedule(trace: DataFrame, speed: float = 1.0) -> DataFrame:
    """The trace with ``due``, microseconds after the start of a replay at a multiple of the recorded speed."""
    begin = trace.agg(F.min("ts").alias("begin"))
    return trace.join(F.broadcast(begin)).withColumn("due", F.floor((F.col("ts") - F.col("begin")) / speed)).drop("begin")

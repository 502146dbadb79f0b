"""Change capture: batches of a log since a sequence number, and logs followed as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from logweave.operators.compact import compact_stripes
from logweave.operators.resolve import resolve
from logweave.plans.ranged import row_numbers
from logweave.plans.scratch import new_path


def updates_since(log: DataFrame, seqno: int) -> DataFrame:
    """Entries from a sequence number on, in order."""
    return log.where(F.col("seqno") >= seqno).orderBy("seqno")


def gaps(log: DataFrame) -> DataFrame:
    """(after, before) around missing seqnos: the largest seqno with no successor, and the next one found.

    A seqno without its predecessor and one without its successor are found by joins on the
    number itself; the i-th end of a run of seqnos goes with the beginning of the next run.
    """
    s = log.select("seqno").distinct()
    ends = s.join(s.select((F.col("seqno") - 1).alias("seqno")), "seqno", "left_anti")
    begins = s.join(s.select((F.col("seqno") + 1).alias("seqno")), "seqno", "left_anti")
    after = row_numbers(ends.select(F.col("seqno").alias("after")), "after")
    before = row_numbers(begins.select(F.col("seqno").alias("before")), "before").withColumn("n", F.col("n") - 1)
    return after.join(before, "n").select("after", "before")


def stream_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 8, bytes_per_trigger: str | None = None) -> DataFrame:
    """A log's folder as a stream of its files, at most so many files (or bytes) in a micro-batch."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(path)


def tail_state(spark: SparkSession, path: str, schema: StructType, **how) -> DataFrame:
    """Follow a log's folder until its end and return the resolved state.

    Every micro-batch adds its entries to those the last state kept: of each key the newest
    entry other than an operand, newer operands, and all range tombstones.  States are
    written tables, so the stream can be taken up again after a failure.
    """
    state: list[DataFrame] = []

    def refresh(batch: DataFrame, number: int) -> None:
        entries = batch if not state else state[-1].unionByName(batch)
        kept = compact_stripes(entries, []).select(*entries.columns)
        at = new_path(spark, f"state-{number}")
        kept.write.parquet(at)
        state.append(spark.read.schema(entries.schema).parquet(at))

    stream = stream_log(spark, path, schema).writeStream.foreachBatch(refresh).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return resolve(state[-1], **how) if state else resolve(spark.createDataFrame([], schema), **how)


def merge_stream(stream: DataFrame, idle: str | None = None) -> DataFrame:
    """A stream of (key, seqno, op, value) folded by a keyed state: after each micro-batch (key, seqno, value) of the keys it touched.

    PUT sets the value, MERGE adds to it, deletions clear it (a null value).  Entries of a
    micro-batch are applied in seqno order; older ones than the state's are too late and left
    out.  With ``idle`` (a duration) a key's state is dropped after that long without entries.
    """
    ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, seqno = state.get if state.exists else (None, -1)
        rows = pd.concat(list(parts)).sort_values("seqno")
        for s, op, v in zip(rows["seqno"].tolist(), rows["op"].tolist(), rows["value"].tolist(), strict=True):
            if s <= seqno:
                continue
            seqno = s
            if op == "PUT":
                value = int(v)
            elif op == "MERGE":
                value = (value or 0) + int(v)
            else:
                value = None
        state.update((value, seqno))
        if ms is not None:
            state.setTimeoutDuration(ms)
        yield pd.DataFrame({"key": [key[0]], "seqno": [seqno], "value": pd.array([value], "Int64")})

    timeout = GroupStateTimeout.NoTimeout if ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kind = stream.schema["key"].dataType.simpleString()
    return stream.select("key", "seqno", "op", F.col("value").cast("bigint").alias("value")).groupBy("key").applyInPandasWithState(
        fold, f"key {kind}, seqno bigint, value bigint", "value bigint, seqno bigint", "update", timeout
    )


def last_state(updates: DataFrame, path: str) -> DataFrame:
    """Run a stream of ``merge_stream`` to its end into a folder, and give each key's last value; cleared keys are left out."""
    spark = updates.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(path)

    updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", new_path(spark, "merge")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(updates.schema).parquet(path)
    return rows.groupBy("key").agg(F.max_by("value", "seqno").alias("value"), F.max("seqno").alias("seqno")).where("value IS NOT NULL")


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Entries by event type in tumbling windows of event time, with late rows up to a watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("entries")).select(F.col("w.start").alias("start"), "event_type", "entries")

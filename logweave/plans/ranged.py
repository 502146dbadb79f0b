"""Totally ordered computations without a single ordering task.

Rows are dealt into ranges of the order and written, with the number of their range;
each range is worked on by itself, and one row for each range carries over what comes
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.plans.scratch import written


def ranged(df: DataFrame, *order) -> DataFrame:
    """df with ``_range``, which grows with the order; equal rows share a range."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def row_numbers(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """df with its row numbers from 1 in the total order."""
    r = ranged(df, *order)
    before = r.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = before.select("_range", F.coalesce(F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = r.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def last_known(df: DataFrame, value: str, *order, name: str) -> DataFrame:
    """df with the last value that is not null at or before each row in the total order."""
    r = ranged(df, *order)
    running = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = r.withColumn(name, F.last(value, ignorenulls=True).over(running))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ends = r.where(F.col(value).isNotNull()).withColumn("_n", place).groupBy("_range").agg(F.max_by(value, "_n").alias("_end"))
    ends = r.select("_range").distinct().join(ends, "_range", "left")
    carried = ends.select("_range", F.last("_end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    return own.join(F.broadcast(carried), "_range").withColumn(name, F.coalesce(name, "_carried")).drop("_range", "_carried")


def _running(df: DataFrame, value: str, order, name: str, add, both) -> DataFrame:
    r = ranged(df, *order)
    parts = r.groupBy("_range").agg(add(value).alias("_part"))
    before = parts.select("_range", add("_part").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = r.withColumn(name, add(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return own.join(F.broadcast(before), "_range").withColumn(name, both(F.col(name), F.col("_before"))).drop("_range", "_before")


def running_max(df: DataFrame, value: str, *order, name: str) -> DataFrame:
    """df with the largest value at or before each row in the total order."""
    return _running(df, value, order, name, F.max, F.greatest)


def running_sum(df: DataFrame, value: str, *order, name: str) -> DataFrame:
    """df with the sum of the values up to each row, itself included, in the total order."""
    return _running(df, value, order, name, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))

"""Joins of points with intervals, without spreading an interval over the points inside it.

Interval ends are numbered in order, and an interval is split into at most 2 log n aligned
blocks of these numbers, as in a segment tree.  A point between two ends lies in log n
blocks, one on each level; points and intervals meet on (level, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.plans.ranged import last_known, row_numbers
from logweave.plans.scratch import written


def _size(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def numbered_ends(spans: DataFrame) -> DataFrame:
    """(p, n): the distinct ends of spans (lo, hi), numbered from 0 in order, as a written table."""
    ends = spans.select(F.col("lo").alias("p")).union(spans.select(F.col("hi"))).where("p IS NOT NULL").distinct()
    return written(row_numbers(ends, "p").select("p", (F.col("n") - 1).alias("n")), "ends")


def levels(ends: DataFrame) -> Column:
    return F.sequence(F.lit(0), F.lit(max(0, ends.count().bit_length())))


def blocks(x: Column, y: Column, depth: Column) -> Column:
    """Blocks (l, i) that make up the numbers from x to y - 1."""

    def borders(level: Column) -> Column:
        low, high = F.ceil(x / _size(level)).cast("bigint"), F.floor(y / _size(level)).cast("bigint")
        some = low < high
        first = F.when(some & (low % 2 == 1), F.struct(level.alias("l"), low.alias("i")))
        return F.array(first, F.when(some & (high % 2 == 1), F.struct(level.alias("l"), (high - 1).alias("i"))))

    return F.array_distinct(F.filter(F.flatten(F.transform(depth, borders)), lambda b: b.isNotNull()))


def around(n: Column, depth: Column) -> Column:
    """The block (l, i) of a number on every level."""
    return F.transform(depth, lambda level: F.struct(level.alias("l"), F.floor(n / _size(level)).cast("bigint").alias("i")))


def spans_over(points: DataFrame, spans: DataFrame, key: str = "key") -> DataFrame:
    """(key, span columns) for every distinct key of points and every span with lo <= key < hi; a null hi is open.

    spans has lo, hi and other columns; empty spans hold nothing.
    """
    rest = [c for c in spans.columns if c not in ("lo", "hi")]
    spans = spans.where("lo IS NOT NULL AND (hi IS NULL OR lo < hi)")
    ends = numbered_ends(spans)
    depth = levels(ends)
    a, b = ends.select(F.col("p").alias("lo"), F.col("n").alias("x")), ends.select(F.col("p").alias("hi"), F.col("n").alias("y"))
    last = F.lit(ends.count())  # cells run from one end to the next; the last one is open
    placed = spans.join(a, "lo").join(b, "hi", "left").select(*rest, F.explode(blocks(F.col("x"), F.coalesce("y", last), depth)).alias("b")).select(*rest, "b.l", "b.i")
    marks = ends.select(F.col("p").alias("at"), F.lit(0).alias("asked"), "n")
    asked = points.select(F.col(key).alias("at"), F.lit(1).alias("asked"), F.lit(None).cast("bigint").alias("n")).where("at IS NOT NULL").distinct()
    cells = last_known(marks.unionByName(asked), "n", "at", "asked", name="cell").where("asked = 1 AND cell IS NOT NULL")
    cells = cells.select(F.col("at").alias(key), F.explode(around(F.col("cell"), depth)).alias("b")).select(key, "b.l", "b.i")
    return cells.join(placed, ["l", "i"]).drop("l", "i")

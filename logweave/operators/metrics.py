"""Metrics: histograms, spans, time-weighted distributions, bursts and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_bounds(most: int) -> list[int]:
    """Bucket limits 1, 2 and then half as much again, cut to two leading digits, until ``most`` is covered."""
    out, exact = [1, 2], 2.0
    while out[-1] < most:
        exact *= 1.5
        n, scale = int(exact), 1
        while n // 10 > 10:
            n //= 10
            scale *= 10
        out.append(n * scale)
    return out


def log_histogram(rows: DataFrame, value: str, bounds: list[int]) -> DataFrame:
    """(bucket, low, high, n): values v with low < v <= high, by the limits."""
    limits = F.array(*[F.lit(b) for b in bounds])
    at = F.aggregate(limits, F.lit(0), lambda s, b: s + (b < F.col(value)).cast("int"))
    by = rows.where(F.col(value).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    low = F.when(F.col("bucket") > 0, F.try_element_at(limits, F.col("bucket"))).otherwise(F.lit(0))
    return by.select("bucket", low.alias("low"), F.coalesce(F.try_element_at(limits, F.col("bucket") + 1), F.lit(bounds[-1])).alias("high"), "n")


def histogram_percentiles(rows: DataFrame, value: str, bounds: list[int], percents: list[float]) -> DataFrame:
    """(percent, estimate): linear within the bucket that reaches the rank, kept between the least and greatest value."""
    h = log_histogram(rows, value, bounds)
    upto = h.withColumn("upto", F.sum("n").over(Window.orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ends = rows.agg(F.min(value).alias("least"), F.max(value).alias("most"))
    marks = upto.join(F.broadcast(ends)).withColumn("percent", F.explode(F.array(*[F.lit(float(p)) for p in percents])))
    rank = F.col("total") * F.col("percent") / 100
    inside = marks.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    position = (rank - (F.col("upto") - F.col("n"))) / F.col("n")
    estimate = F.greatest(F.col("least"), F.least(F.col("most"), F.col("low") + (F.col("high") - F.col("low")) * position))
    return inside.select("percent", F.round(estimate, 6).alias("estimate"))


def spans(rows: DataFrame, active: Column, order: str, by: str) -> DataFrame:
    """(by, start, stop, rows) of the runs of active rows in each series."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("active", active).withColumn("begins", (F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))).cast("int"))
    numbered = marked.withColumn("span", F.sum("begins").over(w)).where("active")
    return numbered.groupBy(by, "span").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("rows")).drop("span")


def time_weighted(rows: DataFrame, value: Column, order: str, by: str, end: int) -> DataFrame:
    """(by, level, duration): how long each series stood at each level, the last row until ``end``."""
    nxt = F.lead(order, 1, end).over(Window.partitionBy(by).orderBy(order, "seqno"))
    return rows.withColumn("level", value).withColumn("lasts", nxt - F.col(order)).groupBy(by, "level").agg(F.sum("lasts").alias("duration"))


def bursts(series: DataFrame, value: str, order: str, by: str, back: int, percent: float) -> DataFrame:
    """Rows whose value changed, against ``back`` rows before, by at least so many percent a unit of time."""
    w = Window.partitionBy(by).orderBy(order)
    before, then = F.lag(value, back).over(w), F.lag(order, back).over(w)
    rate = (F.col(value) - before) * 100 / before / (F.col(order) - then)
    return series.withColumn("rate", F.round(rate, 6)).where(F.abs(F.col("rate")) >= percent)


def pivot(rows: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    """One row for each value of ``row``, a column with the sum of ``value`` for each of the given values."""
    return rows.groupBy(row).agg(*[F.sum(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values])


#: Aggregates that a time-series condition may name.
SERIES = {
    "avg": lambda v, t: F.avg(v),
    "max": lambda v, t: F.max(v),
    "min": lambda v, t: F.min(v),
    "latest": lambda v, t: F.max_by(v, t),
    "oldest": lambda v, t: F.min_by(v, t),
}


def aggregated(series: DataFrame, value: str, order: str, by: str, name: str, over: float) -> DataFrame:
    """Series whose aggregate of the given name is above a limit."""
    return series.groupBy(by).agg(SERIES[name](F.col(value), F.col(order)).alias("aggregate")).where(F.col("aggregate") > over)


def deltas(counters: DataFrame, value: str, order: str, by: str) -> DataFrame:
    """Change of a counter since the row before."""
    return counters.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def log_rules(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, lines) of text lines (line) that match each rule's pattern."""
    hits = F.filter(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules]), lambda x: x.isNotNull())
    return lines.select(F.explode(hits).alias("rule")).groupBy("rule").agg(F.count("*").alias("lines"))


def event_pairs(events: DataFrame, start: str, finish: str) -> DataFrame:
    """(job, start_ts, finish_ts) of events (ts, event, job): each start with the first finish of its job after it."""
    w = Window.partitionBy("job").orderBy("ts", "event").rowsBetween(1, Window.unboundedFollowing)
    end = F.first(F.when(F.col("event") == finish, F.col("ts")), ignorenulls=True).over(w)
    return events.withColumn("finish_ts", end).where(F.col("event") == start).select("job", F.col("ts").alias("start_ts"), "finish_ts")

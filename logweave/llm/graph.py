"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.plans.scratch import written


def connected_components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of links (a, b), root the smallest id it reaches.

    Alternates the large-star and small-star steps: each gives every node's larger
    (or smaller) neighbours the smallest id near it, as grouped minima and a join, so
    that no task needs a node's whole neighbourhood and a hub is split like any skewed
    join.  The number of rounds grows with the logarithm of the longest path.  Each
    round is a written table; nothing but two sums reaches the driver.  Links with a
    null end and loops are left out.
    """
    e = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "links")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")

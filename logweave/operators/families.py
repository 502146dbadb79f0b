"""Reads across column families, overlays of uncommitted writes, and transaction checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.resolve import resolve
from logweave.plans.scratch import written


def coalesce_families(cells: DataFrame) -> DataFrame:
    """(key, name, value) of cells (key, cf_order, name, value): of each column the last family's value."""
    return cells.groupBy("key", "name").agg(F.max_by("value", "cf_order").alias("value"))


def attribute_groups(cells: DataFrame) -> DataFrame:
    """(key, groups): an entity's columns by family, in family order, from cells (key, cf_order, cf, name, value)."""
    by = cells.groupBy("key", "cf_order", "cf").agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("columns"))
    return by.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("cf_order", "cf", "columns"))).alias("groups"))


def overlay(base: DataFrame, delta: DataFrame, **how) -> DataFrame:
    """Resolve base with a delta of uncommitted entries (``pos`` orders them) on top of all of it."""
    top = base.agg(F.coalesce(F.max("seqno"), F.lit(0)).alias("top"))
    lifted = delta.join(F.broadcast(top)).withColumn("seqno", F.col("top") + 1 + F.col("pos")).drop("top", "pos")
    return resolve(base.unionByName(lifted, allowMissingColumns=True), **how)


def conflicts(tracked: DataFrame, log: DataFrame) -> DataFrame:
    """Tracked (txn, key, read_seqno) whose key has a newer entry in the log: the transaction must fail.

    The log is reduced to each key's newest seqno before the join.
    """
    newest = log.groupBy("key").agg(F.max("seqno").alias("newest"))
    return tracked.join(newest, "key").where(F.col("newest") > F.col("read_seqno")).select("txn", "key", "read_seqno", "newest")


def committed(log: DataFrame, commits: DataFrame, snapshot: int, min_uncommitted: int = 0) -> DataFrame:
    """Entries of prepared transactions (prep_seq) that a snapshot sees, by commits (prep_seq, commit_seq).

    prep_seq 0 is always seen; one after the snapshot never; one below ``min_uncommitted``, where
    all was committed when the snapshot was taken, is; others if their commit is at most the
    snapshot.
    """
    joined = log.join(commits, "prep_seq", "left")
    by_commit = (F.col("prep_seq") < min_uncommitted) | F.coalesce(F.col("commit_seq") <= snapshot, F.lit(False))
    seen = (F.col("prep_seq") == 0) | ((F.col("prep_seq") <= snapshot) & by_commit)
    return joined.where(seen).drop("commit_seq")


def lock_overlaps(locks: DataFrame, width: int) -> DataFrame:
    """Pairs of range locks (txn, lo, hi) of different transactions that overlap, by cells of ``width`` keys."""
    cells = locks.where("lo < hi").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    a, b = (cells.select(*[F.col(c).alias(f"{x}_{c}") for c in ("txn", "lo", "hi")], "cell") for x in ("a", "b"))
    hit = a.join(b, "cell").where("a_txn < b_txn AND a_lo < b_hi AND b_lo < a_hi")
    first = F.floor(F.greatest("a_lo", "b_lo") / width) == F.col("cell")
    return hit.where(first).drop("cell")


def _trimmed(edges: DataFrame, trims: int) -> tuple[DataFrame, int]:
    """Edges (a, b) without vertices that nothing leads to or from, after at most ``trims`` rounds, and their number."""
    count = edges.count()
    for _ in range(trims):
        both = edges.select(F.col("a").alias("n")).intersect(edges.select(F.col("b").alias("n")))
        edges = written(edges.join(both.withColumnRenamed("n", "a"), "a", "left_semi").join(both.withColumnRenamed("n", "b"), "b", "left_semi"), "edges")
        before, count = count, edges.count()
        if count in (0, before):
            break
    return edges, count


def _components(edges: DataFrame, trims: int) -> list[DataFrame]:
    """(n, c): vertices of the edges (a, b) that may lie on cycles, and their strong component, in parts.

    In each round a vertex gets the largest vertex that leads to it as its colour; those of its
    colour from which that vertex can be reached are a component, and edges between colours are in none.
    """
    parts = []
    edges, count = _trimmed(edges, trims)
    while count:
        colours = written(edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct().select("n", F.col("n").alias("c"), F.lit(True).alias("new")), "colours")
        while colours.where("new").limit(1).count():
            sent = colours.where("new").join(edges, F.col("n") == F.col("a")).groupBy(F.col("b").alias("n")).agg(F.max("c").alias("more"))
            better = F.coalesce(F.col("more") > F.col("c"), F.lit(False))
            colours = written(colours.drop("new").join(sent, "n", "left").select("n", F.when(better, F.col("more")).otherwise(F.col("c")).alias("c"), better.alias("new")), "colours")
        a, b = (colours.select(F.col("n").alias(x), F.col("c").alias(f"{x}_c")) for x in ("a", "b"))
        edges = written(edges.join(a, "a").join(b, "b").where("a_c = b_c").select("a", "b", F.col("a_c").alias("c")), "edges")
        found = last = written(colours.where("n = c").select("n", "c"), "found")
        while last.limit(1).count():
            back = edges.join(last.select(F.col("n").alias("b")), "b").select(F.col("a").alias("n"), "c").distinct()
            last = written(back.join(found, "n", "left_anti"), "found")
            found = written(found.unionByName(last), "found")
        parts.append(found)
        rest = edges.join(found.select(F.col("n").alias("a")), "a", "left_anti").join(found.select(F.col("n").alias("b")), "b", "left_anti")
        edges, count = _trimmed(written(rest.select("a", "b"), "edges"), trims)
    return parts


def deadlocks(waits: DataFrame, trims: int = 16) -> DataFrame:
    """Transactions of waits (waiter, holder) that wait for themselves over any number of edges.

    Who waits for one holder is followed along such waiters in steps of twice the length each
    round: so a path or cycle of n edges takes log n rounds of a row for each waiter.  Those who
    are still reached when no more drop out are the cycles of such waiters.  The others,
    who wait for several, are joined by edges in place of the paths between them; of what is
    left after ``trims`` rounds of dropping ends, strong components are taken, and the paths
    inside a component are marked, in the same steps.
    """
    edges = written(waits.where("waiter IS NOT NULL AND holder IS NOT NULL").select("waiter", "holder").distinct(), "waits")
    degree = edges.groupBy("waiter").agg(F.count("*").alias("n"), F.min("holder").alias("at"))
    single = written(degree.where("n = 1").select(F.col("waiter").alias("v"), "at"), "single")
    onward = single.select(F.col("v").alias("at"), F.lit(True).alias("onward"))
    steps = [written(single.join(onward, "at", "left").select("v", "at", F.coalesce("onward", F.lit(False)).alias("onward")), "steps")]
    reached = steps[0].where("onward").select("at").distinct()
    count, before = reached.count(), -1
    while count not in (0, before):
        far, before = steps[-1], count
        twice = far.where("onward").select("v", F.col("at").alias("mid")).join(far.select(F.col("v").alias("mid"), "at", "onward"), "mid")
        steps.append(written(twice.select("v", "at", "onward").unionByName(far.where("NOT onward")), "steps"))
        reached = steps[-1].where("onward").select("at").distinct()
        count = reached.count()
    out = reached.select(F.col("at").alias("txn"))

    several = written(degree.where("n > 1").select(F.col("waiter").alias("a")), "several")
    if not several.limit(1).count():
        return out
    ends = steps[-1].where("NOT onward").select(F.col("v").alias("x"), F.col("at").alias("b"))
    paths = edges.join(several.withColumnRenamed("a", "waiter"), "waiter").select(F.col("waiter").alias("a"), F.col("holder").alias("x")).join(ends, "x", "left")
    paths = paths.select("a", "x", F.coalesce("b", "x").alias("b"))
    paths = written(paths.join(several.withColumnRenamed("a", "b"), "b", "left_semi"), "paths")
    for part in _components(written(paths.select("a", "b").distinct(), "edges"), trims):
        a, b = (part.select(F.col("n").alias(x), F.col("c").alias(f"{x}_c")) for x in ("a", "b"))
        inside = written(paths.join(a, "a").join(b, "b").where("a_c = b_c").select("a", "x", "b"), "inside")
        marked = inside.where("x <> b").select(F.col("x").alias("v"))
        for far in steps:
            marked = written(marked.union(far.where("onward").join(marked, "v", "left_semi").select("at")).distinct(), "marked")
        out = out.union(inside.select("a")).union(marked)
    return out.distinct()

"""Version resolution: what a log says at a snapshot.

Order matters: visibility, then range tombstones, then the newest entry of each key,
then dropping tombstones; value filters come last.  Keys are found with partial
aggregates and joins, so that a key with very many versions is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.merge_ops import MergeOp
from logweave.plans import intervals
from logweave.plans.ranged import last_known
from logweave.schema import DELETES, MERGE, RDEL

#: Range tombstones are compared by a broadcast range join up to this many, else through fragments.
BROADCAST_TOMBSTONES = 10_000


def visible(log: DataFrame, as_of_seq: int | None = None, as_of_ts=None, from_ts=None) -> DataFrame:
    """Entries that a snapshot sees: seqno and ts at most as given (ts at least from_ts)."""
    if as_of_seq is not None:
        log = log.where(F.col("seqno") <= as_of_seq)
    if as_of_ts is not None:
        log = log.where(F.col("ts") <= F.lit(as_of_ts))
    if from_ts is not None:
        log = log.where(F.col("ts") >= F.lit(from_ts))
    return log


def fragments(tombstones: DataFrame) -> DataFrame:
    """Disjoint (start, stop, seqno) of range tombstones (key, end_key, seqno), the largest seqno in each.

    Tombstones that end where or before they start are ignored.  A wide tombstone is never
    spread over all ends inside it: it meets the cells between ends in blocks.
    """
    t = tombstones.where("key < end_key").groupBy(F.col("key").alias("lo"), F.col("end_key").alias("hi")).agg(F.max("seqno").alias("seqno"))
    ends = intervals.numbered_ends(t)
    depth = intervals.levels(ends)
    cells = ends.join(ends.select((F.col("n") - 1).alias("n"), F.col("p").alias("stop")), "n")
    a, b = ends.select(F.col("p").alias("lo"), F.col("n").alias("x")), ends.select(F.col("p").alias("hi"), F.col("n").alias("y"))
    placed = t.join(a, "lo").join(b, "hi").select("seqno", F.explode(intervals.blocks(F.col("x"), F.col("y"), depth)).alias("b"))
    top = placed.groupBy("b.l", "b.i").agg(F.max("seqno").alias("seqno"))
    asked = cells.select("n", F.explode(intervals.around(F.col("n"), depth)).alias("b")).select("n", "b.l", "b.i")
    found = asked.join(top, ["l", "i"]).groupBy("n").agg(F.max("seqno").alias("seqno"))
    return cells.join(found, "n").select(F.col("p").alias("start"), "stop", "seqno")


def cover(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    """points with ``cover_seq``, the largest seqno of a range tombstone over the key that is newer than the entry (else null)."""
    t = tombstones.where("key < end_key").select(F.col("key").alias("rd_lo"), F.col("end_key").alias("rd_hi"), F.col("seqno").alias("rd_seq"))
    if t.count() > BROADCAST_TOMBSTONES:
        t = fragments(tombstones).select(F.col("start").alias("rd_lo"), F.col("stop").alias("rd_hi"), F.col("seqno").alias("rd_seq"))
        marks = t.select(F.col("rd_lo").alias("x"), F.struct("rd_hi", "rd_seq").alias("f"), F.lit(0).alias("asked"))
        ends = points.select("key").distinct().select(F.col("key").alias("x"), F.lit(None).cast(marks.schema["f"].dataType).alias("f"), F.lit(1).alias("asked"))
        held = last_known(marks.unionByName(ends), "f", "x", "asked", name="span").where("asked = 1")
        at = held.where("span.rd_hi > x").select(F.col("x").alias("key"), F.col("span.rd_seq").alias("rd_seq"))
        return points.join(at, "key", "left").withColumn("cover_seq", F.when(F.col("rd_seq") > F.col("seqno"), F.col("rd_seq"))).drop("rd_seq")
    over = (F.col("key") >= F.col("rd_lo")) & (F.col("key") < F.col("rd_hi")) & (F.col("rd_seq") > F.col("seqno"))
    hit = points.join(F.broadcast(t), over).groupBy("key", "seqno").agg(F.max("rd_seq").alias("cover_seq"))
    return points.join(hit, ["key", "seqno"], "left")


def apply_range_tombstones(log: DataFrame) -> DataFrame:
    """Point entries of a log, those under a newer range tombstone turned into deletions."""
    if "end_key" not in log.columns:
        return log
    points = cover(log.where(F.col("op") != RDEL), log.where(F.col("op") == RDEL))
    return points.withColumn("op", F.when(F.col("cover_seq").isNotNull(), "DEL").otherwise(F.col("op"))).drop("cover_seq", "end_key")


def _newest(log: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seqno").alias("e")).select(*keys, *[F.col(f"e.{c}").alias(c) for c in rest])


def latest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest entry of each key, tombstones included."""
    return _newest(log, keys or ["key"])


def resolve(
    log: DataFrame, as_of_seq: int | None = None, as_of_ts=None, merge: MergeOp | None = None, ignore_range_deletions: bool = False, keys: list[str] | None = None
) -> DataFrame:
    """Keys alive at a snapshot, with their value.

    Without a merge operator the newest entry's row is returned, an operand as it is (its
    op says so; ``Store.read`` refuses).  With one: keys, value
    and last_seqno, where operands newer than the newest other entry are folded onto that
    entry's value (onto nothing, if it is a deletion or there is none).
    """
    keys = keys or ["key"]
    seen = visible(log, as_of_seq, as_of_ts)
    if ignore_range_deletions and "end_key" in seen.columns:
        seen = seen.where(F.col("op") != RDEL).drop("end_key")
    seen = apply_range_tombstones(seen)
    if merge is None:
        return latest(seen, keys).where(~F.col("op").isin(*DELETES))
    merge = merge.of(seen.schema["value"].dataType)
    base = seen.where(F.col("op") != MERGE).groupBy(*keys).agg(F.max_by(F.struct("op", "value", "seqno"), "seqno").alias("base"))
    operands = seen.where(F.col("op") == MERGE).join(base, keys, "left").where(F.coalesce(F.col("seqno") > F.col("base.seqno"), F.lit(True)))
    folded = merge.folded(operands.select(*keys, "seqno", "value"), keys)
    alive = F.col("merge_seqno").isNotNull() | ~F.col("base.op").isin(*DELETES)
    value = F.when(~F.col("base.op").isin(*DELETES), F.col("base.value"))
    both = base.join(folded, keys, "full").where(alive)
    return both.select(*keys, merge.combine(value, F.col("folded")).alias("value"), F.coalesce("merge_seqno", "base.seqno").alias("last_seqno"))


def merge_operands(log: DataFrame, as_of_seq: int | None = None, most: int | None = None) -> DataFrame:
    """(key, operands) oldest to newest, unfolded, the base value first; more than ``most`` is an error."""
    seen = apply_range_tombstones(visible(log, as_of_seq))
    base = seen.where(F.col("op") != MERGE).groupBy("key").agg(F.max_by(F.struct("op", "seqno"), "seqno").alias("base"))
    held = seen.join(base, "key", "left").where(F.coalesce(F.col("seqno") > F.col("base.seqno"), F.lit(True)) | ((F.col("seqno") == F.col("base.seqno")) & ~F.col("base.op").isin(*DELETES)))
    out = held.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seqno", "value"))).alias("o"))
    ops = F.transform("o", lambda x: x["value"])
    if most is not None:
        ops = F.when(F.size("o") <= most, ops).otherwise(F.raise_error(F.lit("more operands than expected")).cast("array<bigint>"))
    return out.select("key", ops.alias("operands"))


def history(log: DataFrame, from_ts=None, to_ts=None) -> DataFrame:
    """All versions in a time range, tombstones as rows."""
    return visible(log, as_of_ts=to_ts, from_ts=from_ts)


def seqno_of_time(mapping: DataFrame, asked: DataFrame) -> DataFrame:
    """For (id, ts) the largest mapped seqno with time at most ts, of mapping (seqno, ts); null before the first."""
    marks = mapping.select("ts", "seqno", F.lit(None).cast("long").alias("id")).unionByName(asked.select("ts", F.lit(None).cast("long").alias("seqno"), F.col("id").cast("long").alias("id")))
    marks = marks.withColumn("asked", F.col("id").isNotNull())
    return last_known(marks, "seqno", "ts", "asked", "seqno", "id", name="found").where("asked").select("id", "ts", F.col("found").alias("seqno"))


def stripe(seqno: Column, snapshots: list[int]) -> Column:
    """How many snapshots are older than an entry: entries of one stripe are seen by the same snapshots."""
    out = F.lit(0)
    for s in snapshots:
        out = out + (F.lit(s) < seqno).cast("int")
    return out

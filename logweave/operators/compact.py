"""Compaction as queries: rewrites of a log that leave every read at a live snapshot as it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators import resolve as _resolve
from logweave.operators.merge_ops import MergeOp
from logweave.operators.resolve import cover, stripe
from logweave.plans.ranged import last_known, row_numbers, running_max, running_sum
from logweave.plans.scratch import written
from logweave.schema import DELETES, MERGE, PUT, RDEL, SDEL


def _uncovered(points: DataFrame, tombstones: DataFrame, snapshots: list[int]) -> DataFrame:
    """Point entries (with stripe) that no newer range tombstone of their own stripe covers."""
    t = tombstones.where("key < end_key")
    if t.count() <= _resolve.BROADCAST_TOMBSTONES:
        t = t.select(F.col("key").alias("rd_lo"), F.col("end_key").alias("rd_hi"), F.col("seqno").alias("rd_seq"), F.col("stripe").alias("rd_stripe"))
        over = (F.col("key") >= F.col("rd_lo")) & (F.col("key") < F.col("rd_hi")) & (F.col("rd_seq") > F.col("seqno")) & (F.col("rd_stripe") == F.col("stripe"))
        return points.join(F.broadcast(t), over, "left_anti")
    parts = [cover(points.where(F.col("stripe") == i), t.where(F.col("stripe") == i)).where("cover_seq IS NULL").drop("cover_seq") for i in range(len(snapshots) + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compact_stripes(log: DataFrame, snapshots: list[int]) -> DataFrame:
    """Of each key and stripe only what a snapshot can see: the newest entry other than an operand, and newer operands.

    Entries under a newer range tombstone of their own stripe go, range tombstones stay.  A
    single deletion that meets a write of its key in its stripe goes together with it, if
    the key has no entries in older stripes.
    """
    keyed = log.withColumn("stripe", stripe(F.col("seqno"), snapshots))
    ranges = None
    if "end_key" in log.columns:
        ranges = keyed.where(F.col("op") == RDEL)
        keyed = _uncovered(keyed.where(F.col("op") != RDEL), ranges, snapshots)
    writes = F.sum((~F.col("op").isin(*DELETES)).cast("int"))
    base = keyed.where(F.col("op") != MERGE).groupBy("key", "stripe").agg(F.max("seqno").alias("base_seqno"), F.max_by("op", "seqno").alias("base_op"), writes.alias("writes"))
    seen = keyed.join(base, ["key", "stripe"], "left").where(F.coalesce(F.col("seqno") >= F.col("base_seqno"), F.lit(True)))
    oldest = keyed.groupBy("key").agg(F.min("stripe").alias("oldest"))
    paired = base.where((F.col("base_op") == SDEL) & (F.col("writes") > 0)).join(oldest, "key").where("stripe = oldest")
    paired = paired.select("key", F.col("base_seqno").alias("seqno"))
    out = seen.drop("base_seqno", "base_op", "writes").join(paired, ["key", "seqno"], "left_anti")
    return out if ranges is None else out.unionByName(ranges)


def drop_bottom_deletes(striped: DataFrame) -> DataFrame:
    """Deletions with no older version of their key left have nothing to hide at the bottom level.

    So have range tombstones of the oldest stripe, once their stripe is compacted.
    """
    points = striped.where(F.col("op") != RDEL)
    oldest = points.groupBy("key").agg(F.min("seqno").alias("oldest"))
    out = points.join(oldest, "key").where(~(F.col("op").isin(*DELETES) & (F.col("seqno") == F.col("oldest")))).drop("oldest")
    return out.unionByName(striped.where((F.col("op") == RDEL) & (F.col("stripe") > 0)))


def drop_absent_below(striped: DataFrame, below: DataFrame) -> DataFrame:
    """Deletions of the oldest stripe whose key lies in no file of the levels below (smallest, largest) have nothing to hide.

    Of a key with older versions in the oldest stripe only the newest entry is left there, so
    a deletion there is the key's last word.
    """
    doomed = striped.where(F.col("op").isin(*DELETES) & (F.col("stripe") == 0))
    inside = (F.col("key") >= F.col("smallest")) & (F.col("key") <= F.col("largest"))
    spans = below.select("smallest", "largest")
    if spans.count() <= _resolve.BROADCAST_TOMBSTONES:
        needed = doomed.join(F.broadcast(spans), inside, "left_semi")
    else:
        # the file that begins last at or before a key is not enough where files overlap: carry the largest end so far
        marks = spans.select(F.col("smallest").alias("key"), F.lit(0).alias("asked"), F.col("largest").alias("end"))
        marks = marks.unionByName(doomed.select("key", F.lit(1).alias("asked"), F.lit(None).cast(marks.schema["end"].dataType).alias("end")).distinct())
        held = running_max(marks, "end", "key", "asked", name="far").where("asked = 1 AND far >= key")
        needed = doomed.join(held.select("key"), "key", "left_semi")
    rest = striped.where(~(F.col("op").isin(*DELETES) & (F.col("stripe") == 0)))
    return rest.unionByName(needed)


def fold_stripes(striped: DataFrame, merge: MergeOp, bottom: bool = False) -> DataFrame:
    """Operands of a key and stripe folded onto their base in the stripe, as one PUT at the newest operand's seqno.

    Operands without a base stay as they are, unless the log is the bottom and nothing of
    their key is older, when they fold onto nothing.
    """
    points = striped.where(F.col("op") != RDEL)
    merge = merge.of(striped.schema["value"].dataType)
    keys = ["key", "stripe"]
    base = points.where(F.col("op") != MERGE).select(*keys, F.struct("op", "value", "seqno").alias("base"))
    operands = points.where(F.col("op") == MERGE)
    folded = merge.folded(operands.select(*keys, "seqno", "value"), keys)
    oldest = points.groupBy("key").agg(F.min("stripe").alias("oldest"))
    met = folded.join(base, keys, "left").join(oldest, "key")
    ready = met.where(F.col("base").isNotNull() | (F.lit(bottom) & (F.col("stripe") == F.col("oldest"))))
    value = F.when(~F.col("base.op").isin(*DELETES), F.col("base.value"))
    made = ready.select(*keys, F.col("merge_seqno").alias("seqno"), F.lit(PUT).alias("op"), merge.combine(value, F.col("folded")).cast(striped.schema["value"].dataType).alias("value"))
    rest = [c for c in striped.columns if c not in made.columns]
    newest = operands.groupBy(*keys).agg(F.max_by(F.struct("seqno", *rest), "seqno").alias("e")).select(*keys, "e.*") if rest else None
    if newest is not None:
        made = made.join(newest, [*keys, "seqno"])
    done = ready.select(*keys, F.lit(True).alias("done"))
    left = points.join(done, keys, "left").where("done IS NULL").drop("done")
    return left.unionByName(made.select(*left.columns)).unionByName(striped.where(F.col("op") == RDEL))


def compact(log: DataFrame, snapshots: list[int], merge: MergeOp | None = None, bottom: bool = False, newest_filter=None, below: DataFrame | None = None) -> DataFrame:
    """A whole compaction of a log (one family): stripes, range tombstones, paired single deletions, folds, deletions.

    newest_filter: a function of the newest stripe's PUT and ENTITY rows, see ``apply_decisions``.
    below: files (smallest, largest) of deeper levels; bottom: there are none.  No read at a
    snapshot, or of the newest state, changes, but by the filter.
    """
    out = compact_stripes(log, snapshots)
    if merge is not None:
        out = fold_stripes(out, merge, bottom)
    if newest_filter is not None:
        mine = F.col("op").isin(PUT, "ENTITY") & (F.col("stripe") == len(snapshots))
        out = out.where(~mine).unionByName(newest_filter(out.where(mine)))
    if bottom:
        out = drop_bottom_deletes(out)
    elif below is not None:
        out = drop_absent_below(out, below)
    return out.select(*log.columns)


#: What a compaction filter can decide of an entry.
KEEP, REMOVE, CHANGE_VALUE, CHANGE_ENTITY, PURGE, SKIP_UNTIL = "keep", "remove", "change_value", "change_entity", "purge", "skip_until"


def apply_decisions(rows: DataFrame, decision: Column, value: Column | None = None, columns: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows (unique keys) after a filter's decisions.

    ``remove`` leaves a deletion, ``purge`` a single deletion; ``change_value`` makes a PUT of
    ``value``, ``change_entity`` an ENTITY of ``columns``; ``skip_until`` drops the row and all
    keys before ``until`` without a trace.  The filter is not asked about skipped keys.  An
    ``until`` that is not beyond its key counts as keep.  Null decisions keep.
    """
    kind = F.coalesce(decision, F.lit(KEEP))
    rows = rows.withColumn("_d", kind)
    if until is not None:
        rows = _skip(rows.withColumn("_until", F.when((kind == SKIP_UNTIL) & (until > F.col("key")), until)))
    new_value = F.col("value") if value is None else F.when(F.col("_d") == CHANGE_VALUE, value).otherwise(F.col("value"))
    op = F.when(F.col("_d") == REMOVE, "DEL").when(F.col("_d") == PURGE, SDEL).when(F.col("_d") == CHANGE_VALUE, PUT).when(F.col("_d") == CHANGE_ENTITY, "ENTITY").otherwise(F.col("op"))
    gone = F.col("_d").isin(REMOVE, PURGE)
    changed = rows.withColumn("_v", F.when(~gone, new_value)).withColumn("_o", op)
    if columns is not None:
        changed = changed.withColumn("columns", F.when(F.col("_d") == CHANGE_ENTITY, columns).when(~F.col("_d").isin(REMOVE, PURGE, CHANGE_VALUE), F.col("columns")))
    return changed.withColumn("value", F.col("_v")).withColumn("op", F.col("_o")).drop("_d", "_v", "_o")


def _skip(rows: DataFrame) -> DataFrame:
    """rows without those that a skip in force covers; skips that begin under another are not in force.

    The skips in force are those reached from the first one by going to the first skip at or
    after each one's end; jumps double from round to round.
    """
    rows = written(rows, "decided")
    skips = rows.where("_until IS NOT NULL").select("key", F.col("_until").alias("until"))
    ends = skips.select(F.col("until").alias("at"), F.lit(None).cast(skips.schema["key"].dataType).alias("skip"), F.lit(0).alias("asked"), F.col("key").alias("from"))
    begins = skips.select(F.col("key").alias("at"), F.col("key").alias("skip"), F.lit(1).alias("asked"), F.lit(None).cast(skips.schema["key"].dataType).alias("from"))
    found = last_known(ends.unionByName(begins), "skip", F.desc("at"), F.desc("asked"), name="next")
    jump = written(found.where("asked = 0").select(F.col("from").alias("key"), "next"), "jump")
    reach = written(skips.agg(F.min("key").alias("key")).where("key IS NOT NULL"), "reach")
    count = reach.count()
    while count:
        further = reach.join(jump, "key").where("next IS NOT NULL").select(F.col("next").alias("key"))
        reach = written(reach.union(further).distinct(), "reach")
        now = reach.count()
        if now == count:
            break
        count = now
        twice = jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.key"), "left").select(F.col("a.key").alias("key"), F.col("b.next").alias("next"))
        jump = written(twice, "jump")
    force = skips.join(reach, "key", "left_semi").select(F.col("key").alias("at"), "until", F.lit(0).alias("asked"))
    asked = rows.select(F.col("key").alias("at"), F.lit(None).cast(skips.schema["until"].dataType).alias("until"), F.lit(1).alias("asked"))
    held = last_known(force.unionByName(asked), "until", "at", "asked", name="upto").where("asked = 1")
    kept = held.where("upto IS NULL OR at >= upto").select(F.col("at").alias("key"))
    return rows.join(kept, "key", "left_semi").drop("_until")


def remove_empty_values(rows: DataFrame) -> DataFrame:
    """Rows but those whose value is empty, which become deletions."""
    return apply_decisions(rows, F.when(F.length("value") == 0, REMOVE))


def purge_cells(rows: DataFrame, now: int, grace: int, purge_expired: bool = True) -> DataFrame:
    """Cells (key, kind, idx, ts, value, ttl) after a purge at time ``now``, in seconds.

    An expiring cell (with a ttl) past its time goes, or becomes a cell tombstone where
    ``purge_expired`` is false; tombstones (of cells or rows) older than ``grace`` go.
    """
    over = F.col("ttl").isNotNull() & (F.col("ts") + F.col("ttl") <= now)
    kind = F.when((F.col("kind") == "cell") & over, "cell_tombstone").otherwise(F.col("kind"))
    turned = rows.withColumn("_was", F.col("kind")).withColumn("kind", kind)
    turned = turned.withColumn("ts", F.when((F.col("kind") == "cell_tombstone") & (F.col("_was") == "cell"), F.col("ts") + F.col("ttl")).otherwise(F.col("ts")))
    turned = turned.withColumn("value", F.when(F.col("kind") == "cell", F.col("value")))
    expired = (F.col("_was") == "cell") & (F.col("kind") == "cell_tombstone")
    stale_ = F.col("kind").isin("tombstone", "cell_tombstone") & (F.col("ts") + grace <= now)
    gone = (expired & F.lit(purge_expired)) | stale_
    return turned.where(~F.coalesce(gone, F.lit(False))).drop("_was")


def output_files(rows: DataFrame, boundary: Column, target: int, size: Column | None = None) -> DataFrame:
    """Sorted rows with ``file``: a new one where the boundary changes (a key prefix, say) or the target size is full.

    Sizes are added up in key order within a boundary, range by range.
    """
    sized = rows.withColumn("_b", boundary).withColumn("_s", (size if size is not None else F.lit(1)).cast("bigint"))
    numbered = row_numbers(sized, "_b", "key", name="_n")
    heads = numbered.groupBy("_b").agg(F.min("_n").alias("_first"))
    if size is None:
        part = F.floor((F.col("_n") - F.col("_first")) / target)
        out = numbered.join(heads, "_b").withColumn("_part", part)
    else:
        upto = F.sum("_s").over(Window.partitionBy("_b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
        out = numbered.withColumn("_part", F.floor(F.coalesce(upto, F.lit(0)) / target))
    return out.withColumn("file", F.concat_ws("-", F.col("_b").cast("string"), F.col("_part").cast("string"))).drop("_b", "_s", "_n", "_first", "_part")


def pick_level(files: DataFrame, base: int, multiplier: int, trigger: int, cursor=None) -> DataFrame:
    """Files (level, file_id, size, smallest, largest) of the next leveled compaction, with ``role`` input or overlap.

    The level of the largest score (from 1 on) gives its input: all of level 0, else the
    first file, in key order, that begins after ``cursor`` (round robin; the first of all at
    the end).  Files of the next level that overlap the input go along.  No rows if no score
    reaches 1.
    """
    scores = level_scores(files, base, multiplier, trigger).where("score >= 1").orderBy(F.desc("score"), "level").limit(1).collect()
    if not scores:
        return files.limit(0).withColumn("role", F.lit(""))
    level = scores[0].level
    mine = files.where(F.col("level") == level)
    if level:
        after = mine.where(F.col("smallest") > F.lit(cursor)) if cursor is not None else mine
        chosen = after.orderBy("smallest", "file_id").limit(1)
        if cursor is not None and not chosen.count():
            chosen = mine.orderBy("smallest", "file_id").limit(1)
        mine = chosen
    span = mine.agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    over = files.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("smallest") <= F.col("hi")) & (F.col("largest") >= F.col("lo"))).drop("lo", "hi")
    return mine.withColumn("role", F.lit("input")).unionByName(over.withColumn("role", F.lit("overlap")))


def pick_universal(runs: list[tuple[int, int]], trigger: int = 4, size_ratio: int = 1, amplification: int = 200, least: int = 2, most: int = 1 << 30) -> tuple[str, list[int]]:
    """(reason, run ids) of the next universal compaction, from (run id, size), newest first.

    Nothing below ``trigger`` runs.  Else, in this order: all runs, if those newer than the
    oldest come to ``amplification`` percent of it; the newest stretch in which every run is
    within ``size_ratio`` percent of what was gathered before it, from ``least`` to ``most``
    runs long; the newest runs, as many as bring their number under the trigger.
    """
    if len(runs) < trigger:
        return "", []
    newer = sum(size for _, size in runs[:-1])
    if len(runs) > 1 and newer * 100 >= amplification * runs[-1][1]:
        return "size amplification", [i for i, _ in runs]
    for start in range(len(runs)):
        total, end = runs[start][1], start + 1
        while end < len(runs) and end - start < most and total * (100 + size_ratio) >= 100 * runs[end][1]:
            total += runs[end][1]
            end += 1
        if end - start >= least:
            return "size ratio", [i for i, _ in runs[start:end]]
    return "run count", [i for i, _ in runs[: min(most, max(least, len(runs) - trigger + 2))]]


def history_trim(log: DataFrame, ts) -> DataFrame:
    """Entries written at or before ts."""
    return log.where(F.col("ts") <= F.lit(ts))


def gc_timestamps(log: DataFrame, low) -> DataFrame:
    """Entries at or after a low-water time, and of each key the newest one before it."""
    old = log.where(F.col("ts") < F.lit(low))
    kept = old.groupBy("key").agg(F.max_by(F.struct(*[c for c in log.columns if c != "key"]), F.struct("ts", "seqno")).alias("e"))
    kept = kept.select("key", "e.*").select(*log.columns)
    return log.where(F.col("ts") >= F.lit(low)).unionByName(kept)


def compaction_filter(newest: DataFrame, remove: Column, change: Column | None = None) -> DataFrame:
    """Newest versions with a filter's decision: removed rows become deletions, operands just go, values may change."""
    gone = F.coalesce(remove, F.lit(False))
    value = F.col("value") if change is None else F.when(change.isNotNull() & ~gone, change).otherwise(F.col("value"))
    out = newest.withColumn("value", value).withColumn("op", F.when(gone & (F.col("op") != MERGE), "DEL").otherwise(F.col("op")))
    return out.where(~(gone & (newest["op"] == MERGE)))


def stale(write_time: Column, ttl: int, now: int) -> Column:
    """Whether an entry has outlived its time to live; never if ttl is not positive."""
    return F.lit(False) if ttl <= 0 else write_time.cast("long") + F.lit(ttl).cast("long") < F.lit(now).cast("long")


def fifo_pick(files: DataFrame, capacity: int, ttl_before=None) -> DataFrame:
    """Files (file_id, size, newest) that a first-in first-out policy drops.

    Oldest first until the rest fits the capacity; with ttl_before, those older than it if
    dropping them alone brings the total under the capacity.
    """
    by_size = running_sum(files, "size", F.desc("newest"), F.desc("file_id"), name="kept_size").where(F.col("kept_size") > capacity)
    if ttl_before is None:
        return by_size.drop("kept_size")
    expired = files.where(F.col("newest") < F.lit(ttl_before))
    rest = files.where(F.col("newest") >= F.lit(ttl_before)).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return expired if rest <= capacity else by_size.drop("kept_size")


def size_amplification(runs: DataFrame, percent: int) -> DataFrame:
    """Whether sorted runs (age, size; the largest age is the oldest) call for a full merge."""
    oldest = F.max_by("size", "age")
    return runs.agg(oldest.alias("oldest"), (F.sum("size") - oldest).alias("newer")).withColumn("fires", 100 * F.col("newer") >= percent * F.col("oldest"))


def subcompaction_ranges(sizes: DataFrame, parts: int) -> DataFrame:
    """(part, lo, hi, size) of key ranges of about equal size, from sizes (key, size) of anchor keys."""
    total = sizes.agg(F.sum("size").alias("total"))
    upto = running_sum(sizes, "size", "key", name="upto").join(F.broadcast(total))
    part = F.least(F.lit(parts - 1), F.floor((F.col("upto") - F.col("size")) * parts / F.col("total"))).cast("int")
    return upto.groupBy(part.alias("part")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("size"))


def merge_cells(rows: DataFrame) -> DataFrame:
    """Cells (key, idx, ts, value) that survive row tombstones: the latest of each column, newer than the key's newest tombstone.

    rows: (key, kind, idx, ts, value) with kind ``cell`` or ``tombstone``.
    """
    dead = rows.where("kind = 'tombstone'").groupBy("key").agg(F.max("ts").alias("dead_ts"))
    cells = rows.where("kind = 'cell'").groupBy("key", "idx").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("c"))
    joined = cells.join(dead, "key", "left").where("dead_ts IS NULL OR c.ts > dead_ts")
    return joined.select("key", "idx", F.col("c.ts").alias("ts"), F.col("c.value").alias("value"))


def deletion_trigger(log: DataFrame, window: int, trigger: int) -> DataFrame:
    """Parts (part) of a log whose entries in key order hold ``trigger`` deletions within ``window`` neighbours."""
    w = Window.partitionBy("part").orderBy("key", F.desc("seqno")).rowsBetween(-(window - 1), 0)
    seen = log.withColumn("near", F.sum(F.col("op").isin(*DELETES).cast("int")).over(w))
    return seen.groupBy("part").agg(F.max("near").alias("most")).withColumn("fires", F.col("most") >= trigger)


def level_scores(files: DataFrame, base: int, multiplier: int, trigger: int) -> DataFrame:
    """(level, score) of files (level, size): level 0 by its number of files against a trigger, others by bytes
    against base * multiplier ** (level - 1); the level of the largest score is compacted first."""
    by = files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    target = F.lit(float(base)) * F.pow(F.lit(float(multiplier)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("files") / trigger).otherwise(F.col("bytes") / target)
    return by.select("level", F.round(score, 6).alias("score"))


def delete_files_in_range(zones: DataFrame, column: str, lo, hi) -> DataFrame:
    """Files that stay when all files wholly inside [lo, hi] are dropped, from a zone map."""
    return zones.where(~((F.col(f"min_{column}") >= F.lit(lo)) & (F.col(f"max_{column}") <= F.lit(hi))))


def tier_by_age(log: DataFrame, now: int, hot_seconds: int) -> DataFrame:
    """The log with ``tier``: hot for entries written in the last so many seconds, else cold."""
    return log.withColumn("tier", F.when(F.col("write_unix_time") >= now - hot_seconds, "hot").otherwise("cold"))


def recovery_filter(log: DataFrame, ignore: Column, stop: Column, corrupt: Column | None = None) -> DataFrame:
    """Entries that are taken over on recovery: those not ignored, before the first entry that stops it.

    An entry before that point for which corrupt holds is an error.
    """
    if corrupt is not None:
        bad = F.raise_error(F.lit("the log is corrupt")).cast("string")
        return recovery_filter(log, ignore, stop).withColumn("op", F.when(F.coalesce(corrupt, F.lit(False)), bad).otherwise(F.col("op")))
    first = log.where(stop).agg(F.min("seqno").alias("first"))
    return log.join(F.broadcast(first)).where((F.col("first").isNull() | (F.col("seqno") < F.col("first"))) & ~F.coalesce(ignore, F.lit(False))).drop("first")


def merge_cost(files: DataFrame, read_mb_s: float, merge_keys_s: float, keys_per_round: int) -> DataFrame:
    """Rounds, read seconds, merge seconds and keys a second of merging files (keys, mb)."""
    total = files.agg(F.sum("keys").alias("keys"), F.sum("mb").alias("mb"))
    rounds = F.ceil(F.col("keys") / keys_per_round)
    io, compute = F.col("mb") / read_mb_s, F.col("keys") / merge_keys_s
    return total.select("keys", rounds.alias("rounds"), F.round(io, 6).alias("io_s"), F.round(compute, 6).alias("merge_s"), F.round(F.col("keys") / (io + compute), 3).alias("keys_per_s"))


def sorted_runs(spark, runs: int, keys: int, seed: int = 23) -> DataFrame:
    """(run, key, value) of ``runs`` runs of unique keys below 2**62, the same for the same seed."""
    step = F.lit((1 << 62) // max(1, runs * keys))
    return spark.range(runs * keys).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(runs)).cast("int").alias("run"),
        (F.col("id") * step + F.pmod(F.xxhash64("id", F.lit(seed + 1)), step)).alias("key"),
        F.xxhash64("id", F.lit(seed + 2)).alias("value"),
    )

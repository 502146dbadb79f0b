"""Analysis of block accesses (ts, seqno, block, size, and labels), and simulated caches."""

from __future__ import annotations

import heapq
import random
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.bytesops import first_above


def label_groups(access: DataFrame, *labels: str) -> DataFrame:
    """Accesses and bytes by the labels, joined by ``-`` in alphabetical order; without labels, all."""
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in sorted(labels)]) if labels else F.lit("all")
    return access.groupBy(name.alias("label")).agg(F.count("*").alias("accesses"), F.sum("size").alias("bytes"))


def timeline(access: DataFrame, label: str, width: int) -> DataFrame:
    """Accesses of each label in each unit of time since the first access."""
    begin = access.agg(F.min("ts").alias("begin"))
    at = F.floor((F.col("ts") - F.col("begin")) / width)
    return access.join(F.broadcast(begin)).groupBy(at.alias("unit"), F.col(label).alias("label")).agg(F.count("*").alias("accesses"))


def skew(access: DataFrame, percents: list[int]) -> DataFrame:
    """Share of accesses that go to the most accessed blocks, up to each percentage of all blocks."""
    counts = access.groupBy("block").agg(F.count("*").alias("n"))
    by = counts.groupBy("n").agg(F.count("*").alias("blocks"))  # few distinct counts stand for all blocks
    upto = Window.orderBy(F.desc("n"))
    ranked = by.select("n", "blocks", (F.sum("blocks").over(upto) - F.col("blocks")).alias("before"), F.sum("blocks").over(Window.partitionBy()).alias("all_blocks"))
    marks = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    top = F.floor(F.col("percent") * F.col("all_blocks") / 100)
    taken = F.greatest(F.lit(0), F.least(F.col("blocks"), top - F.col("before")))
    return marks.groupBy("percent").agg(F.sum(taken * F.col("n")).cast("long").alias("accesses"))


def reuse_intervals(access: DataFrame, bounds: list[int], unit: int = 1_000_000) -> DataFrame:
    """Accesses by the time since the block's access before, in the first bucket above it; null above all."""
    gap = F.floor((F.col("ts") - F.lag("ts").over(Window.partitionBy("block").orderBy("ts", "seqno"))) / unit)
    return access.withColumn("gap", gap).where("gap IS NOT NULL").groupBy(first_above(F.col("gap"), bounds).alias("bucket")).agg(F.count("*").alias("accesses"))


def reuse_lifetimes(access: DataFrame, bounds: list[int], unit: int = 1_000_000) -> DataFrame:
    """Blocks by the time between first and last access; blocks accessed once in the last bucket (null)."""
    life = access.groupBy("block").agg(F.floor((F.max("ts") - F.min("ts")) / unit).alias("life"), F.count("*").alias("n"))
    return life.groupBy(F.when(F.col("n") > 1, first_above(F.col("life"), bounds)).alias("bucket")).agg(F.count("*").alias("blocks"))


def cohorts(access: DataFrame, width: int) -> DataFrame:
    """(window, later, blocks): blocks accessed in a window and again in a later one."""
    begin = access.agg(F.min("ts").alias("begin"))
    seen = access.join(F.broadcast(begin)).select("block", F.floor((F.col("ts") - F.col("begin")) / width).alias("w")).distinct()
    a, b = seen.select("block", F.col("w").alias("window")), seen.select("block", F.col("w").alias("later"))
    return a.join(b, "block").where("later > window").groupBy("window", "later").agg(F.count("*").alias("blocks"))


def reuse_distances(access: DataFrame, scope: str) -> DataFrame:
    """Bytes of distinct blocks between two accesses of a block, within each value of ``scope``: (seqno, distance).

    A binary indexed tree over the accesses of a scope keeps the last access of each
    block, so that each distance takes logarithmic time.
    """

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "seqno"])
        n = len(part)
        sums, last, out = [0] * (n + 1), {}, []

        def add(i: int, v: int) -> None:
            while i <= n:
                sums[i] += v
                i += i & -i

        def upto(i: int) -> int:
            s = 0
            while i:
                s += sums[i]
                i -= i & -i
            return s

        for i, (seqno, block, size) in enumerate(zip(part["seqno"], part["block"], part["size"], strict=True), 1):
            at = last.get(block)
            if at is not None:
                out.append((seqno, upto(i - 1) - upto(at[0])))
                add(at[0], -at[1])
            add(i, int(size))
            last[block] = (i, int(size))
        return pd.DataFrame(out, columns=["seqno", "distance"]).astype("int64")

    return access.groupBy(scope).applyInPandas(tree, "seqno bigint, distance bigint")


def lru_miss_curve(access: DataFrame, scope: str, capacities: list[int]) -> DataFrame:
    """Hits and misses of an LRU cache of each capacity in bytes, by stack distance: a hit is a reuse whose
    distance and own size fit.  Every scope has a cache of its own."""
    distances = reuse_distances(access, scope)
    joined = access.select("seqno", "size").join(distances, "seqno", "left")
    caps = joined.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
    hit = F.coalesce((F.col("distance") + F.col("size") <= F.col("capacity")), F.lit(False))
    return caps.groupBy("capacity").agg(F.count("*").alias("accesses"), F.sum(hit.cast("int")).alias("hits"))


def _lru(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    held: OrderedDict[int, int] = OrderedDict()
    used = hits = 0
    for block, size in rows:
        if block in held:
            hits += 1
            held.move_to_end(block)
            continue
        if size > capacity or size <= 0:
            continue
        held[block] = size
        used += size
        while used > capacity:
            used -= held.popitem(last=False)[1]
    return hits


def _fifo(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    held: OrderedDict[int, int] = OrderedDict()
    used = hits = 0
    for block, size in rows:
        if block in held:
            hits += 1
        elif 0 < size <= capacity:
            held[block] = size
            used += size
            while used > capacity:
                used -= held.popitem(last=False)[1]
    return hits


def _mru(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    held: OrderedDict[int, int] = OrderedDict()
    used = hits = 0
    for block, size in rows:
        if block in held:
            hits += 1
            held.move_to_end(block)
        elif 0 < size <= capacity:
            while used + size > capacity:
                used -= held.popitem(last=True)[1]
            held[block] = size
            used += size
    return hits


def _lfu(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    held: dict[int, tuple[int, int, int]] = {}
    heap: list[tuple[int, int, int]] = []
    used = hits = 0
    for t, (block, size) in enumerate(rows):
        if block in held:
            hits += 1
            n = held[block][0] + 1
        elif 0 < size <= capacity:
            while used + size > capacity:
                n, at, out = heapq.heappop(heap)
                if held.get(out, (0, 0, 0))[:2] == (n, at):
                    used -= held.pop(out)[2]
            used += size
            n = 1
        else:
            continue
        held[block] = (n, t, size)
        heapq.heappush(heap, (n, t, block))
    return hits


def _gdsize(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    held: dict[int, tuple[float, int]] = {}
    heap: list[tuple[float, int]] = []
    used = hits = 0
    level = 0.0
    for block, size in rows:
        if block in held:
            hits += 1
        elif 0 < size <= capacity:
            while used + size > capacity:
                value, out = heapq.heappop(heap)
                if held.get(out, (None, 0))[0] == value:
                    used -= held.pop(out)[1]
                    level = value
            used += size
        else:
            continue
        held[block] = (level + 1 / size, size)
        heapq.heappush(heap, (level + 1 / size, block))
    return hits


def _optimal(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    """Evicts the block whose next access is farthest away."""
    rows = list(rows)
    after, nxt = [len(rows)] * len(rows), {}
    for i in range(len(rows) - 1, -1, -1):
        after[i] = nxt.get(rows[i][0], len(rows))
        nxt[rows[i][0]] = i
    held: dict[int, tuple[int, int]] = {}
    heap: list[tuple[int, int]] = []
    used = hits = 0
    for i, (block, size) in enumerate(rows):
        if block in held:
            hits += 1
        elif 0 < size <= capacity:
            used += size
        else:
            continue
        held[block] = (after[i], size)
        heapq.heappush(heap, (-after[i], block))
        while used > capacity:
            far, out = heapq.heappop(heap)
            if out in held and held[out][0] == -far:
                used -= held.pop(out)[1]
    return hits


def _arc(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    """Adaptive replacement: blocks seen once and blocks seen again share the bytes, as their ghosts' hits ask for."""
    once, again, gone_once, gone_again = (OrderedDict() for _ in range(4))
    used = {id(x): 0 for x in (once, again, gone_once, gone_again)}
    target = hits = 0

    def put(where: OrderedDict, block: int, size: int) -> None:
        where[block] = size
        used[id(where)] += size

    def take(where: OrderedDict, block: int) -> int:
        size = where.pop(block)
        used[id(where)] -= size
        return size

    def evict(prefer_once: bool) -> None:
        source, ghost = (once, gone_once) if once and (prefer_once or not again) else (again, gone_again)
        block = next(iter(source))
        put(ghost, block, take(source, block))
        while used[id(ghost)] > capacity:
            take(ghost, next(iter(ghost)))

    for block, size in rows:
        if block in once or block in again:
            hits += 1
            put(again, block, take(once if block in once else again, block))
            continue
        if not 0 < size <= capacity:
            continue
        known = block in gone_once or block in gone_again
        if block in gone_once:
            target = min(capacity, target + max(size, used[id(gone_again)] * size // max(1, used[id(gone_once)])))
            take(gone_once, block)
        elif block in gone_again:
            target = max(0, target - max(size, used[id(gone_once)] * size // max(1, used[id(gone_again)])))
            take(gone_again, block)
        while used[id(once)] + used[id(again)] + size > capacity:
            evict(used[id(once)] > target)
        put(again if known else once, block, size)
    return hits


def _sampled(score, seed: int = 5, sample: int = 64):
    """A policy that evicts the block of the least score(accesses, first time, last time, size, now) among a random sample."""

    def run(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
        rnd = random.Random(seed)
        held: dict[int, list[int]] = {}
        order: list[int] = []
        place: dict[int, int] = {}
        used = hits = 0
        for now, (block, size) in enumerate(rows):
            if block in held:
                hits += 1
                held[block][0] += 1
                held[block][2] = now
                continue
            if not 0 < size <= capacity:
                continue
            while used + size > capacity:
                few = order if len(order) <= sample else [order[rnd.randrange(len(order))] for _ in range(sample)]
                out = min(few, key=lambda b: (score(*held[b], now), b))
                used -= held.pop(out)[3]
                at, last = place.pop(out), order.pop()
                if last != out:
                    order[at], place[last] = last, at
            held[block] = [1, now, now, size]
            place[block] = len(order)
            order.append(block)
            used += size
        return hits

    return run


_hyperbolic = _sampled(lambda n, first, last, size, now: n / (now - first + 1))


def _cost_class(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    """Blocks in classes by the power of two of their size; the class with the fewest recent hits for its bytes gives its oldest block."""
    classes: dict[int, OrderedDict[int, int]] = {}
    size_of: dict[int, int] = {}
    recent: dict[int, float] = {}
    where: dict[int, int] = {}
    used = hits = 0
    for block, size in rows:
        if block in where:
            c = where[block]
            hits += 1
            recent[c] = recent[c] * 0.99 + 1
            classes[c].move_to_end(block)
            continue
        if not 0 < size <= capacity:
            continue
        while used + size > capacity:
            c = min((k for k in classes if classes[k]), key=lambda k: (recent[k] / size_of[k], k))
            out, gone = classes[c].popitem(last=False)
            del where[out]
            used -= gone
            size_of[c] -= gone
        c = size.bit_length()
        classes.setdefault(c, OrderedDict())[block] = size
        recent.setdefault(c, 0.0)
        size_of[c] = size_of.get(c, 0) + size
        where[block] = c
        used += size
    return hits


def _learned(choose, learn):
    """A cache that asks, at each eviction, which of two policies (0: oldest, 1: rarest) names the block; a miss on a
    block that a policy had evicted teaches that the choice was wrong, a later drop from the ghosts that it was right."""

    def run(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
        rnd = random.Random(11)
        state: dict = {}
        held: OrderedDict[int, int] = OrderedDict()
        count: dict[int, int] = {}
        heap: list[tuple[int, int, int]] = []
        ghosts: OrderedDict[int, tuple[int, tuple]] = OrderedDict()
        used = hits = misses = 0
        for now, (block, size) in enumerate(rows):
            if block in held:
                hits += 1
                held.move_to_end(block)
                count[block] += 1
                heapq.heappush(heap, (count[block], now, block))
                continue
            misses += 1
            if block in ghosts:
                learn(state, *ghosts.pop(block), False)
            if not 0 < size <= capacity:
                continue
            while used + size > capacity:
                context = (1.0, misses / (now + 1), used / capacity)
                arm = choose(state, context, rnd)
                if arm == 0:
                    out = next(iter(held))
                else:
                    while True:
                        n, _, out = heapq.heappop(heap)
                        if out in held and count[out] == n:
                            break
                used -= held.pop(out)
                del count[out]
                ghosts[out] = (arm, context)
                if len(ghosts) > max(16, len(held)):
                    learn(state, *ghosts.popitem(last=False)[1], True)
            held[block] = size
            count[block] = 1
            heapq.heappush(heap, (1, now, block))
            used += size
        return hits

    return run


def _beta(state: dict, context: tuple, rnd: random.Random) -> int:
    draws = [rnd.betavariate(*state.setdefault(arm, [1, 1])) for arm in (0, 1)]
    return int(draws[1] > draws[0])


def _beta_learn(state: dict, arm: int, context: tuple, right: bool) -> None:
    state[arm][0 if right else 1] += 1


def _linear(state: dict, context: tuple, rnd: random.Random, width: float = 0.5) -> int:
    """The arm of the larger upper confidence bound of a ridge regression on the context."""
    x = np.array(context)
    bounds = []
    for arm in (0, 1):
        a, b = state.setdefault(arm, [np.eye(len(x)), np.zeros(len(x))])
        inverse = np.linalg.inv(a)
        bounds.append(float(x @ inverse @ b + width * np.sqrt(x @ inverse @ x)))
    return int(bounds[1] > bounds[0])


def _linear_learn(state: dict, arm: int, context: tuple, right: bool) -> None:
    x = np.array(context)
    state[arm][0] += np.outer(x, x)
    state[arm][1] += x * right


def _ghost_lru(capacity: int, rows: Iterator[tuple[int, int]]) -> int:
    """LRU that admits a block only at its second miss, while its name is among the ghosts (as many bytes as the cache)."""
    held: OrderedDict[int, int] = OrderedDict()
    ghosts: OrderedDict[int, int] = OrderedDict()
    used = shadow = hits = 0
    for block, size in rows:
        if block in held:
            hits += 1
            held.move_to_end(block)
            continue
        if not 0 < size <= capacity:
            continue
        if block not in ghosts:
            ghosts[block] = size
            shadow += size
            while shadow > capacity:
                shadow -= ghosts.popitem(last=False)[1]
            continue
        shadow -= ghosts.pop(block)
        held[block] = size
        used += size
        while used > capacity:
            used -= held.popitem(last=False)[1]
    return hits


POLICIES = {
    "lru": _lru,
    "fifo": _fifo,
    "mru": _mru,
    "lfu": _lfu,
    "gdsize": _gdsize,
    "opt": _optimal,
    "arc": _arc,
    "hyperbolic": _hyperbolic,
    "cost_class": _cost_class,
    "thompson": _learned(_beta, _beta_learn),
    "linucb": _learned(_linear, _linear_learn),
    "ghost_lru": _ghost_lru,
}


def simulate(access: DataFrame, policies: list[str], capacities: list[int], scope: str | None = None) -> DataFrame:
    """(policy, capacity, accesses, hits) of simulated caches, each access in trace order.

    A cache is sequential, so every (policy, capacity, scope) is one group; split a long
    trace by ``scope`` (a shard of the cache) to keep groups bounded.  Rows whose ``no_insert``
    is true may hit, but are never admitted.
    """
    runs = [(p, c) for p in policies for c in capacities]
    asked = access.sparkSession.createDataFrame(runs, "policy string, capacity bigint")
    shard = F.col(scope) if scope else F.lit(0)
    barred = F.coalesce(F.col("no_insert"), F.lit(False)) if "no_insert" in access.columns else F.lit(False)
    size = F.when(barred, 0).otherwise(F.col("size")).alias("size")  # no policy admits a block without bytes
    each = access.select("ts", "seqno", "block", size, shard.alias("shard")).join(F.broadcast(asked))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "seqno"])
        policy, capacity = part["policy"].iloc[0], int(part["capacity"].iloc[0])
        hits = POLICIES[policy](capacity, zip(part["block"].tolist(), part["size"].tolist(), strict=True))
        return pd.DataFrame({"policy": [policy], "capacity": [capacity], "accesses": [len(part)], "hits": [hits]})

    parts = each.groupBy("policy", "capacity", "shard").applyInPandas(run, "policy string, capacity bigint, accesses bigint, hits bigint")
    return parts.groupBy("policy", "capacity").agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"))


def simulate_hybrid(access: DataFrame, capacities: list[int], scope: str | None = None) -> DataFrame:
    """(capacity, accesses, row_hits, block_hits, missed_bytes) of a cache of rows and blocks, of accesses (…, key, row_size, block, size).

    An access asks for its row first, then for its block; a miss brings in both, and the least
    recently used of either kind goes.  One group for each capacity and scope.
    """
    asked = access.sparkSession.createDataFrame([(c,) for c in capacities], "capacity bigint")
    shard = F.col(scope) if scope else F.lit(0)
    each = access.select("ts", "seqno", "key", "row_size", "block", "size", shard.alias("shard")).join(F.broadcast(asked))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, capacity = part.sort_values(["ts", "seqno"]), int(part["capacity"].iloc[0])
        held: OrderedDict[tuple, int] = OrderedDict()
        used = rows = blocks = missed = 0
        for key, row_size, block, size in zip(*(part[c].tolist() for c in ("key", "row_size", "block", "size")), strict=True):
            row, whole = ("r", key), ("b", block)
            if row in held:
                rows += 1
                held.move_to_end(row)
                continue
            if whole in held:
                blocks += 1
                held.move_to_end(whole)
            else:
                missed += size
            for name, n in ((whole, size), (row, row_size)):
                if name not in held and 0 < n <= capacity:
                    held[name] = n
                    used += n
            while used > capacity:
                used -= held.popitem(last=False)[1]
        return pd.DataFrame({"capacity": [capacity], "accesses": [len(part)], "row_hits": [rows], "block_hits": [blocks], "missed_bytes": [missed]})

    parts = each.groupBy("capacity", "shard").applyInPandas(run, "capacity bigint, accesses bigint, row_hits bigint, block_hits bigint, missed_bytes bigint")
    return parts.groupBy("capacity").agg(*[F.sum(c).alias(c) for c in ("accesses", "row_hits", "block_hits", "missed_bytes")])


def miss_timeline(access: DataFrame, scope: str, capacity: int, width: int) -> DataFrame:
    """(unit, accesses, misses) of an LRU cache of a capacity, in units of time since the first access."""
    begin = access.agg(F.min("ts").alias("begin"))
    met = access.select("seqno", "ts", "size").join(reuse_distances(access, scope), "seqno", "left").join(F.broadcast(begin))
    hit = F.coalesce(F.col("distance") + F.col("size") <= capacity, F.lit(False))
    return met.groupBy(F.floor((F.col("ts") - F.col("begin")) / width).alias("unit")).agg(F.count("*").alias("accesses"), F.count_if(~hit).alias("misses"))


def spatial_locality(access: DataFrame, keys_in_block: int) -> DataFrame:
    """Percentage of a block's keys that were accessed, in tenths, and how many blocks fall in each: (tenth, blocks)."""
    used = access.groupBy("block").agg(F.count_distinct("key").alias("keys"))
    tenth = F.least(F.lit(10), F.ceil(F.col("keys") * 10 / keys_in_block)).cast("int")
    return used.groupBy(tenth.alias("tenth")).agg(F.count("*").alias("blocks"))


def block_shares(access: DataFrame, keys_in_block: int) -> DataFrame:
    """For each block the percentage of its keys accessed, of accesses that found their key, and of its bytes accessed.

    access: (block, size, key, found, bytes); a key that is not found is none of the block's, and
    counts for the second share alone.
    """
    found = F.coalesce(F.col("found"), F.lit(False))
    keys = access.where(found).groupBy("block", "key").agg(F.max("bytes").alias("bytes")).groupBy("block").agg(F.count("*").alias("keys"), F.sum("bytes").alias("bytes"))
    hits = access.groupBy("block").agg(F.max("size").alias("size"), F.count("*").alias("accesses"), F.count_if(found).alias("hits"))
    met = hits.join(keys, "block", "left")
    share = lambda a, b: F.round(F.coalesce(a, F.lit(0)) * 100 / b, 4)
    return met.select("block", share(F.col("keys"), F.lit(keys_in_block)).alias("keys_percent"), share(F.col("hits"), F.col("accesses")).alias("hits_percent"), share(F.col("bytes"), F.col("size")).alias("bytes_percent"))


def extreme_blocks(access: DataFrame, k: int) -> DataFrame:
    """The k most and the k least accessed blocks (ties to the smaller block), with ``end`` top or bottom and their rank."""
    counts = access.groupBy("block").agg(F.count("*").alias("accesses"))
    out = None
    for end, order in (("top", F.desc("accesses")), ("bottom", F.asc("accesses"))):
        few = counts.orderBy(order, "block").limit(k)
        ranked = few.withColumn("rank", F.row_number().over(Window.orderBy(order, "block"))).withColumn("end", F.lit(end))
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("end", "rank", "block", "accesses")


def hit_rates(counters: DataFrame) -> DataFrame:
    """Rows with hits and misses, with their ``total`` and ``hit_rate_pct``; no rate without accesses."""
    total = F.col("hits") + F.col("misses")
    return counters.withColumn("total", total).withColumn("hit_rate_pct", F.when(total > 0, F.round(F.col("hits") * 100 / total, 6)))


def caller_share(access: DataFrame, group: str, caller: str) -> DataFrame:
    """Percentage of each group's accesses by caller."""
    by = access.groupBy(group, caller).agg(F.count("*").alias("n"))
    total = by.groupBy(group).agg(F.sum("n").alias("total"))
    return by.join(total, group).select(group, caller, F.round(F.col("n") * 100 / F.col("total"), 4).alias("percent"))


def access_count_summary(access: DataFrame, group: str, bounds: list[int]) -> DataFrame:
    """Blocks of each group by how often they were accessed, in the first bucket above."""
    counts = access.groupBy(group, "block").agg(F.count("*").alias("n"))
    return counts.groupBy(group, first_above(F.col("n"), bounds).alias("bucket")).agg(F.count("*").alias("blocks"))


def next_access_features(access: DataFrame) -> DataFrame:
    """(seqno, block, past, since, until) of every access: accesses before, time since the last and until the next (null: none)."""
    w = Window.partitionBy("block").orderBy("ts", "seqno")
    return access.select("seqno", "block", (F.row_number().over(w) - 1).alias("past"), (F.col("ts") - F.lag("ts").over(w)).alias("since"), (F.lead("ts").over(w) - F.col("ts")).alias("until"))


def size_stats(access: DataFrame, group: str) -> DataFrame:
    """Distinct blocks, bytes, and least, mean and greatest block size of each group."""
    blocks = access.groupBy(group, "block").agg(F.max("size").alias("size"))
    return blocks.groupBy(group).agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.round(F.avg("size"), 6).alias("mean"), F.max("size").alias("most"))

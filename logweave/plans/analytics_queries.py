"""Queries over traces, block accesses and metrics, with the events table as the trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from logweave.operators import cache, metrics, trace
from logweave.plans.registry import query, table
from logweave.plans.scratch import new_path

DAY = 86_400_000_000

_T = "t AS (SELECT epoch_us(ts) AS ts, event_id AS seqno, event_type AS op, user_id AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value_size FROM events)"
_B = f"{_T}, b AS (SELECT *, (ts - (SELECT min(ts) FROM t)) // {DAY} AS bucket FROM t)"


def _trace(spark, d):
    return table(spark, d, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seqno"), F.col("event_type").alias("op"), F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("long").alias("value_size")
    )


@query(f"WITH {_T}, s AS (SELECT op, key, count(*) AS accesses, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(value_size) AS BIGINT) AS value_bytes FROM t GROUP BY op, key) SELECT *, row_number() OVER (PARTITION BY op ORDER BY key) - 1 AS key_id FROM s")
def trace_key_stats(spark, d):
    return trace.key_stats(_trace(spark, d))


@query(f"WITH {_T}, c AS (SELECT op, key, count(*) AS accesses FROM t GROUP BY op, key HAVING count(*) > 10) SELECT op, accesses, count(*) AS keys FROM c GROUP BY op, accesses")
def trace_count_dist(spark, d):
    return trace.count_distribution(_trace(spark, d), 10)


@query(f'WITH {_T}, g AS (SELECT value_size // 8 AS b, count(*) AS records FROM t GROUP BY 1) SELECT b * 8 AS "begin", (b + 1) * 8 AS "end", records FROM g')
def trace_value_sizes(spark, d):
    return trace.value_size_distribution(_trace(spark, d))


@query(f'WITH {_T}, g AS (SELECT value_size // 8 AS b, count(*) AS records FROM t WHERE value_size // 8 % 3 <> 1 GROUP BY 1) SELECT coalesce(lag((b + 1) * 8) OVER (ORDER BY b), 0) AS "begin", (b + 1) * 8 AS "end", records FROM g')
def trace_value_sizes_compat(spark, d):
    return trace.value_size_distribution(_trace(spark, d).where("floor(value_size / 8) % 3 <> 1"), compat=True)


@query(f"WITH {_T} SELECT key // 10 AS prefix, count(*) AS accesses, count(DISTINCT key) AS keys, round(count(*) / count(DISTINCT key), 6) AS average FROM t GROUP BY 1")
def trace_prefix(spark, d):
    return trace.prefix_stats(_trace(spark, d), 10)


@query(f"WITH {_B}, g AS (SELECT * FROM (SELECT unnest(range(0, (SELECT max(bucket) + 1 FROM b))) AS bucket), (SELECT DISTINCT op FROM t)) SELECT g.bucket, g.op, count(b.ts) AS records FROM g LEFT JOIN b ON b.bucket = g.bucket AND b.op = g.op GROUP BY g.bucket, g.op")
def trace_qps(spark, d):
    return trace.rates(_trace(spark, d), DAY)


@query(f"WITH {_B}, f AS (SELECT key, min(bucket) AS bucket FROM b GROUP BY key), n AS (SELECT bucket, count(*) AS new_keys FROM f GROUP BY bucket) SELECT bucket, new_keys, CAST(sum(new_keys) OVER (ORDER BY bucket) AS BIGINT) AS unique_keys, round(sum(new_keys) OVER (ORDER BY bucket) / sum(new_keys) OVER (), 6) AS share FROM n")
def trace_unique_keys(spark, d):
    return trace.running_unique_keys(_trace(spark, d), DAY)


@query(f"WITH {_B}, top AS (SELECT bucket, count(*) AS total FROM b GROUP BY bucket ORDER BY total DESC, bucket LIMIT 3) SELECT bucket, total, key // 50 AS prefix, count(*) AS accesses FROM b JOIN top USING (bucket) GROUP BY bucket, total, 3")
def trace_topk_seconds(spark, d):
    return trace.top_buckets(_trace(spark, d), 3, 50, DAY)


@query(f"WITH {_T}, l AS (SELECT *, last_value(CASE WHEN op = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seqno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM t) SELECT 'view' AS first_op, 'purchase' AS then_op, count(*) AS pairs, round(avg(ts - prev), 3) AS mean_gap FROM l WHERE op = 'purchase' AND ts > prev")
def trace_correlation(spark, d):
    return trace.correlation(_trace(spark, d), "view", "purchase")


@query(f"WITH {_T} SELECT (SELECT count(*) FROM customer) AS keys, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT key FROM t)) AS accessed")
def trace_coverage(spark, d):
    return trace.coverage(_trace(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


@query(f"WITH {_T}, c AS (SELECT op, key, count(*) AS n FROM t GROUP BY op, key) SELECT op, count(*) AS keys, CAST(sum(n) AS BIGINT) AS accesses, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM c GROUP BY op")
def trace_overall(spark, d):
    return trace.overall(_trace(spark, d))


_A = "a AS (SELECT epoch_us(ts) AS ts, event_id AS seqno, user_id % 40 AS block, 1 + user_id % 40 % 7 AS size, event_type AS caller, user_id % 4 AS cf, event_id % 16 AS shard FROM events)"


def _access(spark, d):
    block = F.col("user_id") % 40
    return table(spark, d, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seqno"), block.alias("block"), (1 + block % 7).alias("size"), F.col("event_type").alias("caller"), (F.col("user_id") % 4).alias("cf"), (F.col("event_id") % 16).alias("shard")
    )


@query(f"WITH {_A} SELECT caller || '-' || cf AS label, count(*) AS accesses, CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY 1")
def cache_label_groups(spark, d):
    return cache.label_groups(_access(spark, d), "cf", "caller")


@query(f"WITH {_A} SELECT (ts - (SELECT min(ts) FROM a)) // {DAY} AS unit, caller AS label, count(*) AS accesses FROM a GROUP BY 1, 2")
def cache_timeline(spark, d):
    return cache.timeline(_access(spark, d), "caller", DAY)


@query(f"WITH {_A}, c AS (SELECT block, count(*) AS n FROM a GROUP BY block), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i, count(*) OVER () AS total FROM c), p(percent) AS (VALUES (1), (5), (10), (50), (100)) SELECT percent, CAST(coalesce(sum(n) FILTER (i <= floor(percent * total / 100)), 0) AS BIGINT) AS accesses FROM r, p GROUP BY percent")
def cache_skew(spark, d):
    return cache.skew(_access(spark, d), [1, 5, 10, 50, 100])


_BOUNDS = [1, 60, 600, 3600, 86_400]
_FIRST = "CASE " + " ".join(f"WHEN {{0}} < {b} THEN {b}" for b in _BOUNDS) + " END"


@query(f"WITH {_A}, g AS (SELECT (ts - lag(ts) OVER (PARTITION BY block ORDER BY ts, seqno)) // 1000000 AS gap FROM a) SELECT {_FIRST.format('gap')} AS bucket, count(*) AS accesses FROM g WHERE gap IS NOT NULL GROUP BY 1")
def reuse_interval(spark, d):
    return cache.reuse_intervals(_access(spark, d), _BOUNDS)


@query(f"WITH {_A}, l AS (SELECT block, (max(ts) - min(ts)) // 1000000 AS life, count(*) AS n FROM a GROUP BY block) SELECT CASE WHEN n > 1 THEN {_FIRST.format('life')} END AS bucket, count(*) AS blocks FROM l GROUP BY 1")
def reuse_lifetime(spark, d):
    return cache.reuse_lifetimes(_access(spark, d), _BOUNDS)


@query(f"WITH {_A}, w AS (SELECT DISTINCT block, (ts - (SELECT min(ts) FROM a)) // {7 * DAY} AS w FROM a) SELECT x.w AS \"window\", y.w AS later, count(*) AS blocks FROM w x JOIN w y ON x.block = y.block AND y.w > x.w GROUP BY 1, 2")
def reuse_cohort(spark, d):
    return cache.cohorts(_access(spark, d), 7 * DAY)


_DISTANCE = f"""{_A}, n AS (SELECT *, lag(seqno) OVER (PARTITION BY shard, block ORDER BY ts, seqno) AS prev FROM a),
dist AS (SELECT x.seqno, x.size, coalesce((SELECT sum(size) FROM (SELECT DISTINCT y.block, y.size FROM n y WHERE y.shard = x.shard AND y.seqno > x.prev AND y.seqno < x.seqno)), 0) AS distance FROM n x WHERE prev IS NOT NULL)"""


@query(f"WITH {_DISTANCE} SELECT seqno, CAST(distance AS BIGINT) AS distance FROM dist")
def reuse_distance(spark, d):
    return cache.reuse_distances(_access(spark, d), "shard")


@query(f"WITH {_DISTANCE}, c(capacity) AS (VALUES (10), (40), (80), (160)) SELECT capacity, (SELECT count(*) FROM a) AS accesses, CAST((SELECT count(*) FROM dist WHERE distance + size <= capacity) AS BIGINT) AS hits FROM c")
def lru_miss_curve(spark, d):
    return cache.lru_miss_curve(_access(spark, d), "shard", [10, 40, 80, 160])


@query()
def cache_policies(spark, d):
    return cache.simulate(_access(spark, d), list(cache.POLICIES), [10, 40, 80, 160], "shard")


_CENTS = "v AS (SELECT CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value IS NOT NULL)"
_LIMITS = metrics.histogram_bounds(1_000_000)
_EDGES = "l AS (SELECT unnest([" + ", ".join(map(str, _LIMITS)) + "]) AS hi)"


def _cents(spark, d):
    return table(spark, d, "events").select(F.round(F.col("value") * 100).cast("long").alias("cents"))


_HIST = f"{_CENTS}, {_EDGES}, e AS (SELECT coalesce(lag(hi) OVER (ORDER BY hi), 0) AS low, hi AS high, CAST(row_number() OVER (ORDER BY hi) - 1 AS INT) AS bucket FROM l), h AS (SELECT bucket, low, high, count(*) AS n FROM e JOIN v ON cents <= high AND (cents > low OR bucket = 0) GROUP BY ALL)"


@query(f"WITH {_HIST} SELECT bucket, low, high, n FROM h")
def log_histogram(spark, d):
    return metrics.log_histogram(_cents(spark, d), "cents", _LIMITS)


@query(f"WITH {_HIST}, u AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () AS total FROM h), p(percent) AS (VALUES (50.0::DOUBLE), (95.0), (99.0)) SELECT percent, round(greatest((SELECT min(cents) FROM v), least((SELECT max(cents) FROM v), low + (high - low) * (total * percent / 100 - (upto - n)) / n)), 6) AS estimate FROM u, p WHERE upto >= total * percent / 100 AND upto - n < total * percent / 100")
def histogram_percentiles(spark, d):
    return metrics.histogram_percentiles(_cents(spark, d), "cents", _LIMITS, [50, 95, 99])


@query("WITH m AS (SELECT event_type, event_id, value > 50 AS active FROM events), g AS (SELECT *, CAST(coalesce(active, false) AND NOT coalesce(lag(active) OVER (PARTITION BY event_type ORDER BY event_id), false) AS INT) AS begins FROM m), s AS (SELECT *, sum(begins) OVER (PARTITION BY event_type ORDER BY event_id) AS span FROM g) SELECT event_type, min(event_id) AS start, max(event_id) AS stop, count(*) AS rows FROM s WHERE active GROUP BY event_type, span")
def compaction_spans(spark, d):
    return metrics.spans(table(spark, d, "events").select("event_type", "event_id", "value"), F.coalesce(F.col("value") > 50, F.lit(False)), "event_id", "event_type")


@query("WITH e AS (SELECT event_type, event_id AS seqno, epoch_us(ts) AS since, CAST(floor(value / 25) AS BIGINT) AS level FROM events), n AS (SELECT *, lead(since, 1, (SELECT max(epoch_us(ts)) FROM events)) OVER (PARTITION BY event_type ORDER BY since, seqno) - since AS lasts FROM e) SELECT event_type, level, CAST(sum(lasts) AS BIGINT) AS duration FROM n GROUP BY 1, 2")
def time_weighted_dist(spark, d):
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("seqno"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return metrics.time_weighted(rows, F.floor(F.col("value") / 25), "at", "event_type", rows.agg(F.max("at")).first()[0])


_DAILY = f"s AS (SELECT event_type, epoch_us(ts) // {DAY} AS day, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY)
    return table(spark, d, "events").groupBy("event_type", day.alias("day")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


@query(f"WITH {_DAILY}, r AS (SELECT *, round((cents - lag(cents, 2) OVER w) * 100 / lag(cents, 2) OVER w / (day - lag(day, 2) OVER w), 6) AS rate FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, day, cents, rate FROM r WHERE abs(rate) >= 20")
def burst_detect(spark, d):
    return metrics.bursts(_daily(spark, d), "cents", "day", "event_type", 2, 20)


@query(f"WITH {_DAILY} SELECT day, CAST(sum(cents) FILTER (event_type = 'view') AS BIGINT) AS view, CAST(sum(cents) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(sum(cents) FILTER (event_type = 'purchase') AS BIGINT) AS purchase FROM s GROUP BY day")
def throughput_pivot(spark, d):
    return metrics.pivot(_daily(spark, d), "day", "event_type", ["view", "click", "purchase"], "cents")


@query(f"WITH {_DAILY} SELECT event_type, day, cents, cents - lag(cents) OVER (PARTITION BY event_type ORDER BY day) AS delta FROM s")
def stats_history(spark, d):
    return metrics.deltas(_daily(spark, d), "cents", "day", "event_type")


@query(f"WITH {_DAILY} SELECT event_type, arg_max(cents, day) AS aggregate FROM s GROUP BY 1 HAVING arg_max(cents, day) > 1000")
def series_condition(spark, d):
    return metrics.aggregated(_daily(spark, d), "cents", "day", "event_type", "latest", 1000)


@query("WITH r(rule, p) AS (VALUES ('license', 'Licensed under'), ('digits', '[0-9]{4}'), ('shout', '!!')) SELECT rule, count(*) AS lines FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), r WHERE regexp_matches(line, p) GROUP BY rule")
def log_rules(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return metrics.log_rules(lines, [("license", "Licensed under"), ("digits", "[0-9]{4}"), ("shout", "!!")])


@query("WITH e AS (SELECT user_id AS job, event_id AS ts, event_type AS event FROM events) SELECT job, s.ts AS start_ts, (SELECT min(f.ts) FROM e f WHERE f.job = s.job AND f.event = 'purchase' AND f.ts > s.ts) AS finish_ts FROM e s WHERE s.event = 'signup'")
def event_pairs(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("ts"), F.col("event_type").alias("event"))
    return metrics.event_pairs(events, "signup", "purchase")


@query("SELECT event_type, count(*) AS entries, count(DISTINCT user_id) AS keys, min(event_id) AS smallest_seqno, max(event_id) AS largest_seqno FROM events GROUP BY 1")
def level_properties(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("entries"), F.count_distinct("user_id").alias("keys"), F.min("event_id").alias("smallest_seqno"), F.max("event_id").alias("largest_seqno"))


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS op, max(event_id) AS seqno FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def stream_tail(spark, d):
    from logweave.streaming.cdc import tail_state

    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seqno"), F.when(F.col("event_type") == "error", "DEL").otherwise(F.col("event_type")).alias("op"))
    path = new_path(spark, "tailed")
    log.repartitionByRange(6, "seqno").write.parquet(path)
    return tail_state(spark, path, log.schema).select("key", "op", "seqno")


@query(f"WITH {_A}, u AS (SELECT user_id % 40 AS block, count(DISTINCT user_id) AS keys FROM events GROUP BY 1) SELECT CAST(least(10, ceil(keys * 10 / 6.0)) AS INT) AS tenth, count(*) AS blocks FROM u GROUP BY 1")
def cache_spatial_locality(spark, d):
    return cache.spatial_locality(table(spark, d, "events").select((F.col("user_id") % 40).alias("block"), F.col("user_id").alias("key")), 6)


@query(f"WITH {_A}, n AS (SELECT cf, caller, count(*) AS n FROM a GROUP BY cf, caller) SELECT cf, caller, round(n * 100 / sum(n) OVER (PARTITION BY cf), 4) AS percent FROM n")
def cache_caller_share(spark, d):
    return cache.caller_share(_access(spark, d), "cf", "caller")


@query(f"WITH {_A}, n AS (SELECT cf, block, count(*) AS n FROM a GROUP BY cf, block) SELECT cf, CASE WHEN n < 100 THEN 100 WHEN n < 250 THEN 250 WHEN n < 1000 THEN 1000 END AS bucket, count(*) AS blocks FROM n GROUP BY 1, 2")
def cache_access_summary(spark, d):
    return cache.access_count_summary(_access(spark, d), "cf", [100, 250, 1000])


@query(f"WITH {_A} SELECT seqno, block, CAST(row_number() OVER w - 1 AS INT) AS past, ts - lag(ts) OVER w AS since, lead(ts) OVER w - ts AS until FROM a WINDOW w AS (PARTITION BY block ORDER BY ts, seqno)")
def cache_next_access(spark, d):
    return cache.next_access_features(_access(spark, d))


@query(f"WITH {_A}, b AS (SELECT cf, block, max(size) AS size FROM a GROUP BY cf, block) SELECT cf, count(*) AS blocks, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS least, round(avg(size), 6) AS mean, max(size) AS most FROM b GROUP BY cf")
def cache_block_sizes(spark, d):
    return cache.size_stats(_access(spark, d), "cf")


@query("SELECT event_type AS file_operation, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS bytes, round(avg(user_id), 3) AS mean_latency, max(user_id) AS most_latency FROM events GROUP BY 1")
def io_trace_summary(spark, d):
    io = table(spark, d, "events").select(F.col("event_type").alias("file_operation"), F.col("user_id").alias("latency"), F.get_json_object("props", "$.k").cast("long").alias("len"))
    return trace.io_summary(io)


@query("SELECT event_type || ' 0 ' || json_extract_string(props, '$.k') || ' ' || epoch_us(ts) AS line FROM events")
def trace_readable(spark, d):
    return trace.readable(_trace(spark, d).withColumn("cf", F.lit(0)))

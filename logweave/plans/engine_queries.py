"""Queries over byte values, whole compactions, stores, file pruning, streams, traces and caches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from logweave.functions import bytesops
from logweave.operators import cache, compact, families, index, merge_ops, resolve, scan, skipping, trace
from logweave.plans.analytics_queries import _T, DAY, _trace
from logweave.plans.registry import FOLD, MUT, mutations, query, table
from logweave.plans.scratch import new_path, written
from logweave.plans.store_queries import _COVERED, _STRIPES, _log, _snapshots, _with_ranges
from logweave.sources.store import Store, read_file
from logweave.streaming import cdc

# reads


@query("SELECT range AS key, n_nationkey IS NOT NULL AS found, n_name AS name FROM range(0, 40) LEFT JOIN nation ON n_nationkey = range")
def multi_get_entity(spark, d):
    nation = table(spark, d, "nation")
    state = nation.select(F.col("n_nationkey").cast("bigint").alias("key"), F.lit(None).cast("string").alias("value"), F.create_map(F.lit("name"), F.col("n_name")).alias("columns"))
    out = scan.multi_get_entity(state, spark.range(40).withColumnRenamed("id", "key"))
    return out.select("key", "found", F.col("columns")["name"].alias("name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 50 AND c_custkey < 150 ORDER BY c_custkey DESC LIMIT 20")
def reverse_scan(spark, d):
    return scan.range_scan(table(spark, d, "customer"), 50, 150, "c_custkey", reverse=True, limit=20).select("c_custkey", "c_name")


@query(f"WITH {MUT}, s AS (SELECT max(event_id) // 2 AS s FROM events), h AS (SELECT mut.* FROM mut, s WHERE seqno <= s) SELECT event_type AS cf, key, arg_max(value, seqno) AS value FROM h WHERE event_type IN ('signup', 'click') AND key >= 10 AND key < 60 GROUP BY event_type, key")
def new_iterators(spark, d):
    log = mutations(spark, d).select(F.col("event_type").alias("cf"), "key", "seqno", F.lit("PUT").alias("op"), "value")
    half = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    parts = scan.new_iterators(log, ["signup", "click"], half, 10, 60)
    both = [p.select(F.lit(c).alias("cf"), "key", "value") for c, p in parts.items()]
    return both[0].unionByName(both[1])


@query(f"WITH {MUT}, e AS (SELECT * FROM mut WHERE NOT (event_type = 'error' AND seqno % 50 = 0)) SELECT key, max(seqno) AS seqno, arg_max(value, seqno) AS value FROM e GROUP BY key HAVING arg_max(op, seqno) <> 'DEL'")
def ignore_range_deletions(spark, d):
    return resolve.resolve(_with_ranges(spark, d), ignore_range_deletions=True).select("key", "seqno", "value")


@query("SELECT o_orderkey AS key, 'O' || o_orderkey AS value FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey < 1000")
def key_may_exist(spark, d):
    keys = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("key"))
    filters = skipping.bloom_of(keys, 10 * 65_536, 4)
    asked = spark.range(1000).withColumnRenamed("id", "key")
    state = keys.withColumn("value", F.concat(F.lit("O"), F.col("key").cast("string")))
    return scan.key_may_exist(filters, state, asked).where("value_found").select("key", "value")


@query("WITH r AS (SELECT o_orderkey AS range_id, o_custkey AS lo, o_custkey + 1 + o_orderkey % 3 AS hi FROM orders) SELECT range_id, c_custkey FROM r JOIN customer ON c_custkey >= lo AND c_custkey < hi")
def multi_scan_many(spark, d):
    """As many ranges as orders, which meet the keys through blocks."""
    ranges = table(spark, d, "orders").select(F.col("o_orderkey").alias("range_id"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("hi"))
    return scan.multi_scan(table(spark, d, "customer").select("c_custkey"), ranges, "c_custkey", few=0).select("range_id", "c_custkey")


# files


def _orders_by_price(spark, d):
    """The orders in files sorted by price, and the zones of these files."""
    path = new_path(spark, "orders")
    table(spark, d, "orders").repartitionByRange(8, "o_totalprice").write.parquet(path)
    orders = spark.read.parquet(path)
    named = orders.withColumn("file", F.input_file_name())
    return orders, written(skipping.zone_map(named, "file", "o_totalprice", "o_orderdate"), "zones")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 400000 AND 500000")
def pruned_scan(spark, d):
    orders, zones = _orders_by_price(spark, d)
    kept = skipping.may_match(zones, "o_totalprice", 400_000, 500_000)
    return skipping.read_matching(spark, kept, orders.schema).where("o_totalprice BETWEEN 400000 AND 500000").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 30000 AND o_orderdate >= DATE '1995-01-01'")
def table_filter_scan(spark, d):
    orders, zones = _orders_by_price(spark, d)
    out = skipping.read_matching(spark, zones, orders.schema, table_filter=(F.col("min_o_totalprice") < 30_000) & (F.col("max_o_orderdate") >= F.lit("1995-01-01").cast(orders.schema["o_orderdate"].dataType)))
    return out.where("o_totalprice < 30000 AND o_orderdate >= DATE '1995-01-01'").select("o_orderkey")


@query("WITH z AS (SELECT event_id // 500 AS file, min(epoch_us(ts)) AS min_ts, max(epoch_us(ts)) AS max_ts FROM events GROUP BY 1), m AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS m FROM events) SELECT file FROM z, m WHERE max_ts >= m AND min_ts <= m + 86400000000")
def timestamp_file_skip(spark, d):
    e = table(spark, d, "events").select((F.floor(F.col("event_id") / 500)).alias("file"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    return skipping.may_match(skipping.zone_map(e, "file", "ts"), "ts", (lo + hi) // 2, (lo + hi) // 2 + DAY).select("file")


@query("WITH z AS (SELECT n_regionkey AS file, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY 1) SELECT file FROM z WHERE hi >= 'U' AND lo < 'V'")
def prefix_range_skip(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("file"), F.col("n_name").cast("binary").alias("name"))
    return skipping.prefix_may_match(skipping.zone_map(n, "file", "name"), "name", b"U").select("file")


@query("WITH s AS (SELECT o_custkey % 20 AS file, split_part(o_orderpriority, '-', 1) AS s0, CASE WHEN o_orderpriority LIKE '%-%' THEN split_part(o_orderpriority, '-', 2) END AS s1 FROM orders WHERE o_custkey % 3 = 0), z AS (SELECT file, min(s1) AS lo, max(s1) AS hi, count(*) FILTER (s1 IS NULL) AS missing FROM s GROUP BY file) SELECT file, missing FROM z WHERE missing > 0 OR (hi >= 'M' AND lo <= 'T')")
def segment_skip(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 3 = 0").select((F.col("o_custkey") % 20).alias("file"), F.col("o_orderpriority").alias("key"))
    zones = skipping.segment_zones(o, "file", "key", "-", 2)
    return skipping.segment_may_match(zones, 1, "M", "T").select("file", F.col("missing_s1").alias("missing"))


@query(f"WITH {MUT} SELECT key, seqno, op FROM mut WHERE key >= 20 AND key < 40")
def file_reader(spark, d):
    path = new_path(spark, "file")
    log = _log(spark, d).select("key", "seqno", "op", "value")
    log.coalesce(1).write.parquet(path)
    return read_file(spark, path, log.schema, 20, 40).select("key", "seqno", "op")


# byte values



@query(f"WITH {FOLD}, v AS (SELECT a.key, (coalesce(a.bv, 0) * 4503599627370497::HUGEINT + coalesce(sum(o.value), 0) * 4503599627370497::HUGEINT) % 18446744073709551616::HUGEINT AS n FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv), h AS (SELECT key, format('{{:016X}}', CAST(n AS UBIGINT)) AS h FROM v) SELECT key, concat({', '.join(f'substr(h, {i}, 2)' for i in range(15, 0, -2))}) AS value FROM h")
def resolve_binary_uint64add(spark, d):
    """Counters as eight little-endian bytes, so large that sums wrap."""
    log = mutations(spark, d).select("key", "seqno", "op", bytesops.to_u64_le(F.pmod(F.col("value").cast("decimal(38,0)") * F.lit(4503599627370497).cast("decimal(20,0)"), F.lit(Decimal(1 << 64)))).alias("value"))
    return resolve.resolve(log, merge=merge_ops.uint64add()).select("key", F.hex("value").alias("value"))


@query(f"WITH {FOLD} SELECT a.key, format('{{:016X}}', xor(coalesce(a.bv, 0), coalesce(bit_xor(o.value), 0))) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def resolve_binary_xor(spark, d):
    log = mutations(spark, d).select("key", "seqno", "op", F.unhex(F.lpad(F.hex("value"), 16, "0")).alias("value"))
    return resolve.resolve(log, merge=merge_ops.bytesxor()).select("key", F.lpad(F.hex("value"), 16, "0").alias("value"))


@query(f"WITH {FOLD}, every AS (SELECT key, k FROM operands UNION ALL SELECT key, bk FROM alive WHERE bk IS NOT NULL) SELECT key, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS value FROM every GROUP BY key")
def resolve_binary_sortlist(spark, d):
    log = mutations(spark, d).select("key", "seqno", "op", F.col("k").cast("string").cast("binary").alias("value"))
    return resolve.resolve(log, merge=merge_ops.sortlist()).select("key", F.col("value").cast("string").alias("value"))


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(CASE WHEN a.bk % 8 = 0 THEN 2 ELSE 1 END, 1) * coalesce(product(CASE WHEN o.k % 8 = 0 THEN 2 ELSE 1 END), 1) AS BIGINT) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bk")
def resolve_mul(spark, d):
    log = mutations(spark, d).select("key", "seqno", "op", F.when(F.col("k") % 8 == 0, 2).otherwise(1).cast("bigint").alias("value"))
    return resolve.resolve(log, merge=merge_ops.product()).select("key", F.col("value").cast("bigint").alias("value"))


@query("SELECT n_nationkey AS key, format('{:016X}', CAST(n_nationkey * 1000003 AS UBIGINT)) AS big, CAST(n_nationkey * 1000003 AS BIGINT) AS back FROM nation")
def u64_codec(spark, d):
    n = (F.col("n_nationkey") * 1_000_003).cast("bigint")
    key, ts = bytesops.split_ts(F.concat(F.col("n_name").cast("binary"), bytesops.encode_ts(n)))
    coded = F.hex(bytesops.encode_ts(n))
    big = F.concat(*[F.substring(coded, 15 - 2 * i, 2) for i in range(8)])
    return table(spark, d, "nation").where(key.cast("string") == F.col("n_name")).select(F.col("n_nationkey").alias("key"), big.alias("big"), ts.cast("bigint").alias("back"))


# compaction

_DOOMED = f"""{_COVERED}, t AS (SELECT max(event_id) AS t FROM events),
st AS (SELECT e.*, CAST(seqno > t // 4 AS INT) + CAST(seqno > t // 2 AS INT) + CAST(seqno > t * 3 // 4 AS INT) AS stripe FROM entries e, t),
rs AS (SELECT rd.*, CAST(s > t // 4 AS INT) + CAST(s > t // 2 AS INT) + CAST(s > t * 3 // 4 AS INT) AS rstripe FROM rd, t),
open AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM rs WHERE st.key >= lo AND st.key < hi AND s > st.seqno AND rstripe = stripe)),
ob AS (SELECT key, stripe, max(seqno) AS bs FROM open WHERE op <> 'MERGE' GROUP BY key, stripe)"""


@query(f"WITH {_DOOMED} SELECT key, seqno, op, stripe FROM open LEFT JOIN ob USING (key, stripe) WHERE seqno >= coalesce(bs, -1)")
def compact_range_tombstones(spark, d):
    return compact.compact_stripes(_with_ranges(spark, d), _snapshots(spark, d)).where("op <> 'RDEL'").select("key", "seqno", "op", "stripe")


@query(f"WITH {_STRIPES}, f AS (SELECT key, stripe, max(seqno) AS seqno, sum(value) AS added FROM kept JOIN b USING (key, stripe) WHERE op = 'MERGE' GROUP BY key, stripe) SELECT key, f.seqno, 'PUT' AS op, CAST(added + CASE WHEN kb.op = 'DEL' THEN 0 ELSE kb.value END AS BIGINT) AS value, stripe FROM f JOIN kept kb USING (key, stripe) WHERE kb.op <> 'MERGE' UNION ALL SELECT key, seqno, op, value, stripe FROM kept LEFT JOIN (SELECT key, stripe, true AS done FROM f) USING (key, stripe) WHERE done IS NULL")
def compact_folds(spark, d):
    striped = compact.compact_stripes(_log(spark, d), _snapshots(spark, d))
    return compact.fold_stripes(striped, merge_ops.uint64add()).select("key", "seqno", "op", "value", "stripe")


@query(f"WITH {_STRIPES}, w AS (SELECT key, stripe, count(*) AS writes FROM s WHERE op IN ('PUT', 'ENTITY') GROUP BY key, stripe), o AS (SELECT key, min(stripe) AS oldest FROM s GROUP BY key) SELECT key, seqno, CASE WHEN op = 'DEL' THEN 'SDEL' ELSE op END AS op, stripe FROM kept LEFT JOIN w USING (key, stripe) JOIN o USING (key) WHERE NOT (op = 'DEL' AND coalesce(writes, 0) > 0 AND stripe = oldest)")
def single_delete_pairs(spark, d):
    log = _log(spark, d).withColumn("op", F.when(F.col("op") == "DEL", "SDEL").otherwise(F.col("op")))
    return compact.compact_stripes(log, _snapshots(spark, d)).select("key", "seqno", "op", "stripe")


@query(f"WITH {_STRIPES} SELECT key, seqno, op, stripe FROM kept WHERE NOT (op = 'DEL' AND stripe = 0 AND key % 50 >= 25)")
def drop_absent_below(spark, d):
    """The levels below have a file for the lower half of every fifty keys, however many keys the log has."""
    log = _log(spark, d)
    low = log.where("key % 50 < 25").groupBy(F.expr("key div 50"))
    below = written(low.agg(F.min("key").alias("smallest"), F.max("key").alias("largest")).select("smallest", "largest"), "below")
    return compact.drop_absent_below(compact.compact_stripes(log, _snapshots(spark, d)), below).select("key", "seqno", "op", "stripe")


@query(f"WITH {MUT}, n AS (SELECT key, max(seqno) AS seqno, arg_max(op, seqno) AS op, arg_max(value, seqno) AS value FROM mut WHERE op IN ('PUT', 'ENTITY') GROUP BY key), g AS (SELECT *, CASE WHEN key % 17 = 0 THEN 'skip_until' WHEN value < 1000 THEN 'remove' WHEN value < 2000 THEN 'purge' WHEN value < 3000 THEN 'change_value' ELSE 'keep' END AS dec FROM n) SELECT key, seqno, CASE dec WHEN 'remove' THEN 'DEL' WHEN 'purge' THEN 'SDEL' WHEN 'change_value' THEN 'PUT' ELSE op END AS op, CASE dec WHEN 'remove' THEN NULL WHEN 'purge' THEN NULL WHEN 'change_value' THEN 3000 ELSE value END AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM g s WHERE s.dec = 'skip_until' AND g.key >= s.key AND g.key < s.key + 5)")
def filter_decisions(spark, d):
    newest = resolve.latest(_log(spark, d).drop("ts").where("op IN ('PUT', 'ENTITY')"))
    v = F.col("value")
    decision = F.when(F.col("key") % 17 == 0, compact.SKIP_UNTIL).when(v < 1000, compact.REMOVE).when(v < 2000, compact.PURGE).when(v < 3000, compact.CHANGE_VALUE)
    return compact.apply_decisions(newest, decision, F.lit(3000).cast("bigint"), until=F.col("key") + 5).select("key", "seqno", "op", "value")


@query("WITH r AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN 'tombstone' ELSE 'cell' END AS kind, event_id % 4 AS idx, epoch_us(ts) // 1000000 AS ts, event_id AS value, CASE WHEN event_id % 3 = 0 THEN 86400 * (event_id % 30) END AS ttl FROM events), n AS (SELECT max(ts) AS now FROM r) SELECT key, kind, idx, ts, CASE WHEN kind = 'cell' THEN value END AS value FROM r, n WHERE NOT (kind = 'cell' AND ttl IS NOT NULL AND ts + ttl <= now) AND NOT (kind = 'tombstone' AND ts + 864000 <= now)")
def purge_cells(spark, d):
    e = table(spark, d, "events")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    rows = e.select(F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "tombstone").otherwise("cell").alias("kind"), (F.col("event_id") % 4).alias("idx"), seconds.alias("ts"), F.col("event_id").alias("value"), F.when(F.col("event_id") % 3 == 0, 86_400 * (F.col("event_id") % 30)).alias("ttl"))
    now = rows.agg(F.max("ts")).first()[0]
    return compact.purge_cells(rows, now, 864_000).select("key", "kind", "idx", "ts", "value")


@query("SELECT user_id % 3 AS b, event_id AS key, concat(user_id % 3, '-', (row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1) // 100) AS file FROM events")
def output_files(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("user_id") % 3).alias("b"))
    return compact.output_files(e, F.col("b"), 100).select("b", "key", "file")


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(a.bv, 0) + coalesce(sum(o.value), 0) AS BIGINT) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def store_compaction(spark, d):
    """Two commits, a compaction with a live snapshot and a third commit, read from a store's folder."""
    log = _log(spark, d).select("key", "seqno", "op", "value")
    top = log.agg(F.max("seqno")).first()[0]
    store = Store(spark, new_path(spark, "store"), log.schema, merge_ops.uint64add())
    store.append(log.where(F.col("seqno") <= top // 3))
    store.append(log.where((F.col("seqno") > top // 3) & (F.col("seqno") <= top * 2 // 3)))
    store.compact(snapshots=[top // 2])
    store.append(log.where(F.col("seqno") > top * 2 // 3))
    return store.read().select("key", "value")


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(a.bv, 0) + coalesce(sum(o.value), 0) AS BIGINT) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def stream_tail_merge(spark, d):
    log, path = _log(spark, d).select("key", "seqno", "op", "value"), new_path(spark, "log")
    log.repartitionByRange(6, "seqno").write.parquet(path)
    return cdc.tail_state(spark, path, log.schema, merge=merge_ops.uint64add()).select("key", "value")


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(a.bv, 0) + coalesce(sum(o.value), 0) AS BIGINT) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def stream_keyed_state(spark, d):
    path = new_path(spark, "log")
    log = _log(spark, d).select("key", "seqno", F.when(F.col("op") == "ENTITY", "PUT").otherwise(F.col("op")).alias("op"), "value")
    log.coalesce(1).write.parquet(path)
    return cdc.last_state(cdc.merge_stream(cdc.stream_log(spark, path, log.schema)), new_path(spark, "updates")).select("key", "value")


# indexes, transactions


@query("SELECT lower(substr(c_mktsegment, 1, 3)) AS entry, c_custkey AS primary_key, c_name AS held FROM customer WHERE lower(substr(c_mktsegment, 1, 3)) = 'bui'")
def index_protocol(spark, d):
    customer = table(spark, d, "customer")
    made = index.SecondaryIndex("c_custkey", lambda: F.col("c_mktsegment"), lambda v: F.substring(v, 1, 3), F.lower, lambda: F.col("c_name"))
    return made.search(made.entries(customer), "BUILDING")


@query("WITH m AS (SELECT event_id AS seqno, user_id AS key, event_id % 6 AS p FROM events), c AS (SELECT range AS p, range + 2 AS c FROM range(1, 6)) SELECT key, seqno FROM m LEFT JOIN c USING (p) WHERE p = 0 OR (p <= 4 AND (p < 2 OR c <= 4))")
def prepared_snapshot(spark, d):
    log = mutations(spark, d).select("key", "seqno", (F.col("seqno") % 6).alias("prep_seq"))
    commits = spark.range(1, 6).select(F.col("id").alias("prep_seq"), (F.col("id") + 2).alias("commit_seq"))
    return families.committed(log, commits, 4, min_uncommitted=2).select("key", "seqno")


# traces

_R = "t AS (SELECT epoch_us(ts) AS ts, event_id AS seqno, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'PUT' END AS op, event_type AS cf, user_id AS key, CASE WHEN event_id % 5 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 END AS value_size FROM events)"


def _reads(spark, d):
    t = _trace(spark, d)
    return t.select("ts", "seqno", F.when(F.col("op").isin("view", "click"), "GET").otherwise("PUT").alias("op"), F.col("op").alias("cf"), "key", F.when(F.col("seqno") % 5 == 0, 0).otherwise(F.col("value_size") + 1).alias("value_size"))


@query(f"WITH {_R} SELECT op, cf, key, count(*) AS accesses, count(*) FILTER (op <> 'GET' OR value_size > 0) AS successes FROM t GROUP BY op, cf, key")
def trace_key_success(spark, d):
    return trace.key_success(_reads(spark, d))


@query(f"WITH {_T}, k AS (SELECT DISTINCT op, key FROM t), s AS (SELECT op, CAST(length(CAST(key AS VARCHAR)) AS INT) AS key_size, count(*) AS keys FROM k GROUP BY 1, 2), c AS (SELECT *, sum(keys) OVER (PARTITION BY op ORDER BY key_size) >= sum(keys) OVER (PARTITION BY op) / 2.0 AS past FROM s) SELECT op, key_size, keys, min(CASE WHEN past THEN key_size END) OVER (PARTITION BY op) AS median FROM c")
def trace_key_sizes(spark, d):
    return trace.key_size_distribution(_trace(spark, d))


@query(f"WITH {_R}, p AS (SELECT key // 10 AS prefix, count(*) AS accesses, count(DISTINCT key) AS keys, count(*) FILTER (op <> 'GET' OR value_size > 0) AS ok FROM t GROUP BY 1) SELECT prefix, accesses, keys, round(accesses / keys, 6) AS average, round(ok / accesses, 6) AS success FROM p")
def trace_prefix_success(spark, d):
    return trace.prefix_success(_reads(spark, d), 10)


@query(f"WITH {_R}, p AS (SELECT key // 10 AS prefix, count(*) AS accesses, count(DISTINCT key) AS keys, count(*) FILTER (op <> 'GET' OR value_size > 0) AS ok FROM t GROUP BY 1) SELECT prefix, accesses, keys, round(accesses / keys, 6) AS average, round(ok / accesses, 6) AS success FROM p WHERE prefix < (SELECT max(prefix) FROM p) UNION ALL SELECT 0, 0, 0, 0.0::DOUBLE, 0.0::DOUBLE")
def trace_prefix_success_compat(spark, d):
    return trace.prefix_success(_reads(spark, d), 10, compat=True)


@query(f"WITH {_T}, b AS (SELECT (ts - (SELECT min(ts) FROM t)) // {DAY} AS bucket, op FROM t), n AS (SELECT max(bucket) + 1 AS n FROM b), c AS (SELECT op, bucket, count(*) AS r FROM b GROUP BY 1, 2 UNION ALL SELECT 'all', bucket, count(*) FROM b GROUP BY bucket) SELECT op, max(r) AS peak, round(sum(r) / max(n), 6) AS average FROM c, n GROUP BY op")
def trace_peaks(spark, d):
    return trace.peak_and_average(_trace(spark, d), DAY)


@query(f"WITH {_T}, i AS (SELECT op, key, row_number() OVER (PARTITION BY op ORDER BY key) - 1 AS key_id FROM (SELECT DISTINCT op, key FROM t)) SELECT op, key_id, ts FROM t JOIN i USING (op, key)")
def trace_series(spark, d):
    return trace.access_series(_trace(spark, d))


@query(f"WITH {_COVERED} SELECT key, max(seqno) AS seqno, arg_max(value, seqno) AS value FROM e GROUP BY key HAVING arg_max(op2, seqno) <> 'DEL'")
def trace_replay(spark, d):
    """A trace of writes, range deletions among them, played back into a log and read."""
    recorded = _with_ranges(spark, d).withColumn("ts", F.col("seqno"))
    return resolve.resolve(trace.replay(recorded.withColumn("value_size", F.lit(0)))).select("key", "seqno", "value")


# caches

_A = "a AS (SELECT epoch_us(ts) AS ts, event_id AS seqno, user_id // 4 AS block, user_id AS key, 64 AS size, 16 AS bytes, event_type <> 'error' AS found FROM events)"


def _blocks(spark, d):
    return table(spark, d, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seqno"), F.floor(F.col("user_id") / 4).alias("block"), F.col("user_id").alias("key"), F.lit(64).alias("size"), F.lit(16).alias("bytes"), F.lit(16).alias("row_size"), (F.col("event_type") != "error").alias("found")
    )


@query(f"WITH {_A}, k AS (SELECT block, key, max(bytes) AS bytes FROM a WHERE found GROUP BY block, key), s AS (SELECT block, count(*) AS keys, sum(bytes) AS bytes FROM k GROUP BY block), h AS (SELECT block, max(size) AS size, count(*) AS n, count(*) FILTER (found) AS hits FROM a GROUP BY block) SELECT block, round(coalesce(keys, 0) * 100 / 4, 4) AS keys_percent, round(hits * 100 / n, 4) AS hits_percent, round(coalesce(bytes, 0) * 100 / size, 4) AS bytes_percent FROM h LEFT JOIN s USING (block)")
def cache_block_shares(spark, d):
    return cache.block_shares(_blocks(spark, d), 4)


@query(f"WITH {_A}, c AS (SELECT block, count(*) AS accesses FROM a GROUP BY block), r AS (SELECT 'top' AS \"end\", CAST(row_number() OVER (ORDER BY accesses DESC, block) AS INT) AS rank, block, accesses FROM c UNION ALL SELECT 'bottom', CAST(row_number() OVER (ORDER BY accesses, block) AS INT), block, accesses FROM c) SELECT * FROM r WHERE rank <= 5")
def cache_extremes(spark, d):
    return cache.extreme_blocks(_blocks(spark, d), 5)


@query(f"WITH {_A}, c AS (SELECT block, count(*) FILTER (found) AS hits, count(*) FILTER (NOT found) AS misses FROM a GROUP BY block) SELECT block, hits, misses, hits + misses AS total, round(hits * 100 / (hits + misses), 6) AS hit_rate_pct FROM c")
def cache_hit_rates(spark, d):
    counters = _blocks(spark, d).groupBy("block").agg(F.count_if("found").alias("hits"), F.count_if(~F.col("found")).alias("misses"))
    return cache.hit_rates(counters)


@query(f"WITH {_A}, p AS (SELECT *, lag(seqno) OVER (PARTITION BY block ORDER BY seqno) AS before, (ts - (SELECT min(ts) FROM a)) // {DAY} AS unit FROM a) SELECT CAST(unit AS BIGINT) AS unit, count(*) AS accesses, count(*) FILTER (before IS NULL) AS misses FROM p GROUP BY unit")
def cache_cold_misses(spark, d):
    """Misses of a cache that holds everything: the first access of each block."""
    return cache.miss_timeline(_blocks(spark, d).withColumn("shard", F.lit(0)), "shard", 1 << 40, DAY)


@query()
def cache_hybrid(spark, d):
    return cache.simulate_hybrid(_blocks(spark, d), [128, 512, 1024])

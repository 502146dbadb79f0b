"""Queries over mutation logs: reads, folds, scans, families, transactions, compaction, skipping, indexes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from logweave.functions import bytesops
from logweave.operators import compact, families, index, merge_ops, resolve, scan, skipping
from logweave.plans.registry import FOLD, MUT, mutations, query, table


def _log(spark, d):
    return mutations(spark, d).select("key", "seqno", "ts", "op", "value")


@query(f"WITH {MUT} SELECT key, arg_max(seqno, seqno) AS seqno, arg_max(value, seqno) AS value, arg_max(op, seqno) AS op FROM mut GROUP BY key HAVING arg_max(op, seqno) <> 'DEL'")
def get_latest(spark, d):
    return resolve.resolve(_log(spark, d)).select("key", "seqno", "value", "op")


@query(f"WITH {MUT} SELECT key, arg_max(seqno, seqno) AS seqno, arg_max(value, seqno) AS value, arg_max(op, seqno) AS op FROM mut WHERE key = 7 GROUP BY key HAVING arg_max(op, seqno) <> 'DEL'")
def get_point(spark, d):
    return scan.get(_log(spark, d), 7).select("key", "seqno", "value", "op")


def _folded(spark, d, op, column="value"):
    log = mutations(spark, d).select("key", "seqno", "op", F.col(column).alias("value"))
    return resolve.resolve(log, merge=op)


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(a.bv, 0) + coalesce(sum(o.value), 0) AS BIGINT) AS value, coalesce(max(o.seqno), a.bs) AS last_seqno FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv, a.bs")
def resolve_uint64add(spark, d):
    return _folded(spark, d, merge_ops.uint64add()).orderBy("key")


@query(f"WITH {FOLD} SELECT a.key, greatest(a.bv, max(o.value)) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def resolve_max(spark, d):
    return _folded(spark, d, merge_ops.maximum()).select("key", "value")


@query(f"WITH {FOLD} SELECT a.key, coalesce(arg_max(o.value, o.seqno), a.bv) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def resolve_put(spark, d):
    return _folded(spark, d, merge_ops.put()).select("key", "value")


@query(f"WITH {FOLD} SELECT a.key, concat_ws(',', CAST(a.bk AS VARCHAR), string_agg(CAST(o.k AS VARCHAR), ',' ORDER BY o.seqno)) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bk")
def resolve_stringappend(spark, d):
    return _folded(spark, d, merge_ops.stringappend(), "k").select("key", "value")


@query(f"WITH {FOLD}, every AS (SELECT key, k FROM operands UNION ALL SELECT key, bk FROM alive WHERE bk IS NOT NULL) SELECT key, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS value FROM every GROUP BY key")
def resolve_sortlist(spark, d):
    out = _folded(spark, d, merge_ops.sortlist(), "k")
    return out.select("key", F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("value"))


@query(f"WITH {FOLD} SELECT a.key, xor(coalesce(a.bv, 0), coalesce(bit_xor(o.value), 0)) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def resolve_xor(spark, d):
    return _folded(spark, d, merge_ops.bytesxor()).select("key", "value")


@query(f"WITH {FOLD}, every AS (SELECT key, seqno, k FROM operands UNION ALL SELECT key, -1, bk FROM alive WHERE bk IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno DESC) AS n FROM every) SELECT key, string_agg(CAST(k AS VARCHAR), ',' ORDER BY n) AS value FROM r WHERE n <= 3 GROUP BY key")
def resolve_last3(spark, d):
    out = _folded(spark, d, merge_ops.last(3), "k")
    return out.select("key", F.array_join(F.transform("value", lambda x: x.cast("string")), ",").alias("value"))


@query(
    f"""WITH {MUT}, ops AS (
  SELECT key, seqno, CASE event_type WHEN 'purchase' THEN 'sum' WHEN 'view' THEN 'mul' END AS f, 1 + k % 3 AS v FROM mut
  WHERE event_type IN ('purchase', 'view') AND k IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seqno) AS i FROM ops),
r AS (
  WITH RECURSIVE walk(key, i, f, v) AS (
    SELECT key, i, f, CAST(v AS DOUBLE) FROM n WHERE i = 1
    UNION ALL
    SELECT n.key, n.i, n.f, CASE n.f WHEN 'sum' THEN w.v + n.v ELSE w.v * n.v END FROM walk w JOIN n ON n.key = w.key AND n.i = w.i + 1)
  SELECT * FROM walk)
SELECT key, arg_max(f, i) AS function, round(log10(arg_max(v, i)), 6) AS log_value FROM r GROUP BY key"""
)
def agg_merge_switch(spark, d):
    m = mutations(spark, d).where("event_type IN ('purchase', 'view') AND k IS NOT NULL")
    function = F.when(F.col("event_type") == "purchase", "sum").otherwise("mul")
    out = merge_ops.agg_merge(m.select("key", "seqno", function.alias("function"), (1 + F.col("k") % 3).cast("string").alias("payload")))
    return out.select("key", "function", F.round(F.log10(F.col("value").cast("double")), 6).alias("log_value"))


@query(f"WITH {FOLD}, every AS (SELECT key, seqno, value FROM operands UNION ALL SELECT key, bs, bv FROM alive WHERE bv IS NOT NULL) SELECT key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY seqno) AS operands FROM every GROUP BY key")
def merge_operands(spark, d):
    out = resolve.merge_operands(_log(spark, d))
    return out.select("key", F.array_join(F.transform("operands", lambda x: x.cast("string")), ",").alias("operands"))


@query(f"WITH {MUT}, s AS (SELECT max(event_id) // 2 AS s FROM events) SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno FROM mut, s WHERE seqno <= s GROUP BY key HAVING arg_max(op, seqno) <> 'DEL'")
def snapshot_read(spark, d):
    half = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    return resolve.resolve(_log(spark, d), as_of_seq=half).select("key", "value", "seqno")


_MIDDLE = "(SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM events)"


def _middle(spark, d):
    lo, hi = table(spark, d, "events").agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()
    return (lo + hi) // 2


def _micros(log):
    return log.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query(f"WITH {MUT} SELECT key, arg_max(value, seqno) AS value, max(seqno) AS seqno FROM mut WHERE ts <= {_MIDDLE} GROUP BY key HAVING arg_max(op, seqno) <> 'DEL'")
def asof_ts_read(spark, d):
    return resolve.resolve(_micros(_log(spark, d)), as_of_ts=_middle(spark, d)).select("key", "value", "seqno")


@query(f"WITH {MUT} SELECT key, seqno, op, epoch_us(ts) AS ts_us FROM mut WHERE ts >= {_MIDDLE}")
def history_scan(spark, d):
    return resolve.history(_micros(_log(spark, d)), from_ts=_middle(spark, d)).select("key", "seqno", "op", F.col("ts").alias("ts_us"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey >= 100 AND c_custkey < 200")
def range_scan(spark, d):
    return scan.range_scan(table(spark, d, "customer"), 100, 200, "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 77 ORDER BY c_custkey LIMIT 5")
def seek_next(spark, d):
    return scan.seek(table(spark, d, "customer"), 77, 5, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 77 ORDER BY c_custkey DESC LIMIT 5")
def seek_prev(spark, d):
    return scan.seek_for_prev(table(spark, d, "customer"), 77, 5, "c_custkey").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, (SELECT substr(min(p_name), 1, 3) FROM part))")
def prefix_scan(spark, d):
    part = table(spark, d, "part")
    prefix = part.agg(F.min("p_name")).first()[0][:3]
    return scan.prefix_scan(part, prefix, "p_name").select("p_partkey", "p_name")


_RANGES = [(1, 10, 50), (2, 40, 90), (3, 1000, 1100), (4, 14900, None)]


@query("WITH r(range_id, lo, hi) AS (VALUES (1, 10, 50), (2, 40, 90), (3, 1000, 1100), (4, 14900, NULL)) SELECT range_id, o_orderkey, o_totalprice FROM orders JOIN r ON o_orderkey >= lo AND (hi IS NULL OR o_orderkey < hi)")
def multi_scan(spark, d):
    ranges = spark.createDataFrame(_RANGES, "range_id int, lo bigint, hi bigint")
    return scan.multi_scan(table(spark, d, "orders"), ranges, "o_orderkey").select("range_id", "o_orderkey", "o_totalprice")


@query("SELECT x.key AS o_orderkey, o_totalprice, o_orderkey IS NOT NULL AS found FROM (SELECT CAST(range * 37 AS BIGINT) AS key FROM range(0, 600)) x LEFT JOIN orders ON o_orderkey = x.key")
def multi_get(spark, d):
    keys = spark.range(600).select((F.col("id") * 37).alias("o_orderkey"))
    return scan.multi_get(table(spark, d, "orders"), keys, "o_orderkey").select("o_orderkey", "o_totalprice", "found")


@query(f"WITH {MUT} SELECT count(*) AS entries, sum(strlen(CAST(key AS VARCHAR)) + strlen(coalesce(CAST(value AS VARCHAR), ''))) AS bytes FROM mut WHERE key >= 10 AND key < 60")
def approximate_size(spark, d):
    return scan.approximate_size(_log(spark, d), 10, 60)


_RD = "rd AS (SELECT user_id AS lo, user_id + 5 AS hi, event_id AS s FROM events WHERE event_type = 'error' AND event_id % 50 = 0)"


def _with_ranges(spark, d):
    log = mutations(spark, d)
    is_range = (F.col("event_type") == "error") & (F.col("seqno") % 50 == 0)
    return log.select("key", "seqno", F.when(is_range, "RDEL").otherwise(F.col("op")).alias("op"), "value", F.when(is_range, F.col("key") + 5).alias("end_key"))


_COVERED = f"""{MUT}, {_RD}, entries AS (SELECT * FROM mut WHERE NOT (event_type = 'error' AND seqno % 50 = 0)),
e AS (SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM rd WHERE m.key >= lo AND m.key < hi AND s > m.seqno) THEN 'DEL' ELSE op END AS op2 FROM entries m)"""


@query(f"WITH {_COVERED} SELECT key, max(seqno) AS seqno, arg_max(value, seqno) AS value FROM e GROUP BY key HAVING arg_max(op2, seqno) <> 'DEL'")
def range_delete(spark, d):
    return resolve.resolve(_with_ranges(spark, d)).select("key", "seqno", "value")


@query(f"WITH {_COVERED} SELECT key, seqno FROM e WHERE op <> 'DEL' AND op2 = 'DEL'")
def range_deleted_entries(spark, d):
    log = _with_ranges(spark, d)
    points = log.where("op NOT IN ('RDEL', 'DEL')").select("key", "seqno")
    return resolve.cover(points, log.where("op = 'RDEL'")).where("cover_seq IS NOT NULL").select("key", "seqno")


@query(f"WITH {_RD}, p AS (SELECT lo AS x FROM rd UNION SELECT hi FROM rd), c AS (SELECT x AS start, lead(x) OVER (ORDER BY x) AS stop FROM p) SELECT start, stop, max(s) AS seqno FROM c JOIN rd ON lo <= start AND hi >= stop GROUP BY start, stop")
def tombstone_fragments(spark, d):
    return resolve.fragments(_with_ranges(spark, d).where("op = 'RDEL'"))


def _cells(spark, d):
    families_ = ["signup", "click", "purchase", "view", "error"]
    m = mutations(spark, d).where("event_type IS NOT NULL")
    newest = m.groupBy("key", F.col("event_type").alias("cf")).agg(F.max_by("value", "seqno").alias("value"), F.max_by("k", "seqno").alias("k"))
    order = F.array_position(F.array(*[F.lit(f) for f in families_]), F.col("cf")).cast("int")
    return newest.select("key", "cf", order.alias("cf_order"), F.explode(F.array(F.struct(F.lit("k").alias("name"), F.col("k").alias("value")), F.struct(F.lit("value").alias("name"), F.col("value").alias("value")))).alias("c")).select("key", "cf", "cf_order", "c.name", "c.value").where("value IS NOT NULL")


_CELLS = f"""{MUT}, newest AS (SELECT key, event_type AS cf, list_position(['signup', 'click', 'purchase', 'view', 'error'], event_type) AS o,
  arg_max(value, seqno) AS value, arg_max(k, seqno) AS k FROM mut GROUP BY key, event_type),
cells AS (SELECT key, cf, o, 'k' AS name, k AS value FROM newest UNION ALL SELECT key, cf, o, 'value', value FROM newest)"""


@query(f"WITH {_CELLS} SELECT key, name, arg_max(value, o) AS value FROM cells WHERE value IS NOT NULL GROUP BY key, name")
def coalesce_families(spark, d):
    return families.coalesce_families(_cells(spark, d))


@query(f"WITH {_CELLS}, g AS (SELECT key, cf, o, string_agg(name || '=' || value, ',' ORDER BY name) AS c FROM cells WHERE value IS NOT NULL GROUP BY key, cf, o) SELECT key, string_agg(cf || '{{' || c || '}}', ';' ORDER BY o) AS groups FROM g GROUP BY key")
def attribute_groups(spark, d):
    out = families.attribute_groups(_cells(spark, d))
    column = lambda c: F.concat(c["name"], F.lit("="), c["value"].cast("string"))
    group = lambda g: F.concat(g["cf"], F.lit("{"), F.array_join(F.transform(g["columns"], column), ","), F.lit("}"))
    return out.select("key", F.array_join(F.transform("groups", group), ";").alias("groups"))


@query(f"WITH {FOLD} SELECT a.key, CAST(coalesce(a.bv, 0) + coalesce(sum(o.value), 0) AS BIGINT) AS value FROM alive a LEFT JOIN operands o USING (key) GROUP BY a.key, a.bv")
def overlay_read(spark, d):
    log = _log(spark, d).drop("ts")
    half = table(spark, d, "events").agg(F.max("event_id")).first()[0] // 2
    delta = log.where(F.col("seqno") > half).withColumn("pos", F.col("seqno") - half - 1).drop("seqno")
    return families.overlay(log.where(F.col("seqno") <= half), delta, merge=merge_ops.uint64add()).select("key", "value")


@query("WITH t AS (SELECT event_id AS txn, user_id AS key, event_id AS read_seqno FROM events WHERE event_type = 'purchase'), n AS (SELECT user_id AS key, max(event_id) AS newest FROM events WHERE event_type <> 'view' GROUP BY 1) SELECT txn, key, read_seqno, newest FROM t JOIN n USING (key) WHERE newest > read_seqno")
def txn_conflicts(spark, d):
    m = mutations(spark, d)
    tracked = m.where("event_type = 'purchase'").select(F.col("seqno").alias("txn"), "key", F.col("seqno").alias("read_seqno"))
    return families.conflicts(tracked, m.where("event_type <> 'view'"))


@query("WITH m AS (SELECT event_id AS seqno, user_id AS key, event_id % 5 AS p FROM events), c AS (SELECT range AS p, range * 1000 AS c FROM range(1, 4)) SELECT key, seqno FROM m LEFT JOIN c USING (p) WHERE p = 0 OR c <= 2000")
def prepared_visibility(spark, d):
    log = mutations(spark, d).select("key", "seqno", (F.col("seqno") % 5).alias("prep_seq"))
    commits = spark.range(1, 4).select(F.col("id").alias("prep_seq"), (F.col("id") * 1000).alias("commit_seq"))
    return families.committed(log, commits, 2000).select("key", "seqno")


@query("WITH l AS (SELECT o_orderkey AS txn, o_custkey AS lo, o_custkey + 1 + o_orderkey % 4 AS hi FROM orders) SELECT a.txn AS a_txn, b.txn AS b_txn FROM l a JOIN l b ON a.txn < b.txn AND a.lo < b.hi AND b.lo < a.hi")
def lock_overlaps(spark, d):
    locks = table(spark, d, "orders").select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("lo"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 4).alias("hi"))
    return families.lock_overlaps(locks, 4).select("a_txn", "b_txn")


@query("WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), w AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 31 + 7) % n AS b FROM orders, n), r(a, b) AS (SELECT a, b FROM w UNION SELECT r.a, w.b FROM r JOIN w ON r.b = w.a) SELECT DISTINCT a AS txn FROM r WHERE a = b")
def deadlocks(spark, d):
    n = table(spark, d, "customer").count()
    waits = table(spark, d, "orders").select(F.col("o_custkey").alias("waiter"), ((F.col("o_custkey") * 31 + 7) % n).alias("holder"))
    return families.deadlocks(waits)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def secondary_index_lookup(spark, d):
    customer = table(spark, d, "customer")
    return index.lookup(index.simple_index(customer, "c_mktsegment", "c_custkey"), customer, "BUILDING", "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("WITH b AS (SELECT c_mktsegment AS value, c_custkey AS primary_key FROM customer), a AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'NONE' ELSE c_mktsegment END AS value, c_custkey AS primary_key FROM customer) SELECT value, primary_key, -1 AS change FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) UNION ALL SELECT value, primary_key, 1 FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def secondary_index_changes(spark, d):
    customer = table(spark, d, "customer")
    after = customer.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, "NONE").otherwise(F.col("c_mktsegment")))
    return index.index_changes(index.simple_index(customer, "c_mktsegment", "c_custkey"), index.simple_index(after, "c_mktsegment", "c_custkey"))


def _snapshots(spark, d):
    top = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return [top // 4, top // 2, top * 3 // 4]


_STRIPES = f"""{MUT}, t AS (SELECT max(event_id) AS t FROM events),
s AS (SELECT m.*, CAST(seqno > t // 4 AS INT) + CAST(seqno > t // 2 AS INT) + CAST(seqno > t * 3 // 4 AS INT) AS stripe FROM mut m, t),
b AS (SELECT key, stripe, max(seqno) AS bs FROM s WHERE op <> 'MERGE' GROUP BY key, stripe),
kept AS (SELECT s.* FROM s LEFT JOIN b USING (key, stripe) WHERE seqno >= coalesce(bs, -1))"""


@query(f"WITH {_STRIPES} SELECT key, seqno, op, stripe FROM kept")
def compact_stripes(spark, d):
    return compact.compact_stripes(_log(spark, d), _snapshots(spark, d)).select("key", "seqno", "op", "stripe")


@query(f"WITH {_STRIPES}, o AS (SELECT key, min(seqno) AS oldest FROM kept GROUP BY key) SELECT key, seqno, op, stripe FROM kept JOIN o USING (key) WHERE NOT (op = 'DEL' AND seqno = oldest)")
def compact_bottommost(spark, d):
    return compact.drop_bottom_deletes(compact.compact_stripes(_log(spark, d), _snapshots(spark, d))).select("key", "seqno", "op", "stripe")


@query(f"WITH {MUT}, n AS (SELECT key, max(seqno) AS seqno, arg_max(op, seqno) AS op, arg_max(value, seqno) AS value FROM mut GROUP BY key) SELECT key, seqno, CASE WHEN value < 1000 THEN 'DEL' ELSE op END AS op, CASE WHEN value >= 5000 THEN 5000 ELSE value END AS value FROM n WHERE NOT (value < 1000 AND op = 'MERGE')")
def compaction_filter(spark, d):
    newest = resolve.latest(_log(spark, d).drop("ts"))
    return compact.compaction_filter(newest, F.col("value") < 1000, F.when(F.col("value") >= 5000, F.lit(5000).cast("long"))).select("key", "seqno", "op", "value")


@query(f"WITH {MUT}, now AS (SELECT max(epoch_us(ts)) // 1000000 AS now FROM events) SELECT key, seqno FROM mut, now WHERE NOT (epoch_us(ts) // 1000000 + 604800 < now)")
def ttl_expire(spark, d):
    log = _log(spark, d).withColumn("written", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    now = log.agg(F.max("written")).first()[0]
    return log.where(~compact.stale(F.col("written"), 604_800, now)).select("key", "seqno")


@query(f"WITH {MUT} SELECT key, seqno FROM mut WHERE ts <= {_MIDDLE}")
def history_trim(spark, d):
    return compact.history_trim(_micros(_log(spark, d)), _middle(spark, d)).select("key", "seqno")


@query(f"WITH {MUT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seqno DESC) AS n FROM mut WHERE ts < {_MIDDLE}) SELECT key, seqno FROM r WHERE n = 1 UNION ALL SELECT key, seqno FROM mut WHERE ts >= {_MIDDLE}")
def gc_timestamps(spark, d):
    return compact.gc_timestamps(_micros(_log(spark, d)), _middle(spark, d)).select("key", "seqno")


@query("WITH f AS (SELECT strftime(o_orderdate, '%Y-%m') AS file_id, count(*) AS size, epoch_us(max(o_orderdate)) AS newest FROM orders GROUP BY 1), t AS (SELECT sum(size) // 2 AS cap FROM f), r AS (SELECT *, sum(size) OVER (ORDER BY newest DESC, file_id DESC) AS kept FROM f) SELECT file_id, size FROM r, t WHERE kept > cap")
def fifo_pick(spark, d):
    files = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file_id")).agg(F.count("*").alias("size"), F.unix_micros(F.max(F.col("o_orderdate").cast("timestamp"))).alias("newest"))
    total = files.agg(F.sum("size")).first()[0]
    return compact.fifo_pick(files, total // 2).select("file_id", "size")


@query("WITH f AS (SELECT year(o_orderdate) AS y, count(*) AS size FROM orders GROUP BY 1) SELECT arg_min(size, y) AS oldest, CAST(sum(size) - arg_min(size, y) AS BIGINT) AS newer, 100 * (sum(size) - arg_min(size, y)) >= 200 * arg_min(size, y) AS fires FROM f")
def size_amplification(spark, d):
    runs = table(spark, d, "orders").groupBy((-F.year("o_orderdate")).alias("age")).agg(F.count("*").alias("size"))
    return compact.size_amplification(runs, 200)


@query("WITH s AS (SELECT o_custkey AS key, count(*) AS size FROM orders GROUP BY 1), u AS (SELECT *, sum(size) OVER (ORDER BY key) AS upto, sum(size) OVER () AS total FROM s) SELECT CAST(least(7, floor((upto - size) * 8 / total)) AS INT) AS part, min(key) AS lo, max(key) AS hi, CAST(sum(size) AS BIGINT) AS size FROM u GROUP BY 1")
def subcompaction_ranges(spark, d):
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("size"))
    return compact.subcompaction_ranges(sizes, 8)


@query("WITH r AS (SELECT user_id AS key, event_id % 4 AS idx, epoch_us(ts) AS ts, event_id AS value, event_type = 'error' AND event_id % 3 = 0 AS dead FROM events), t AS (SELECT key, max(ts) AS dts FROM r WHERE dead GROUP BY key), c AS (SELECT *, row_number() OVER (PARTITION BY key, idx ORDER BY ts DESC, value DESC) AS n FROM r WHERE NOT dead) SELECT key, idx, ts, value FROM c LEFT JOIN t USING (key) WHERE n = 1 AND (dts IS NULL OR ts > dts)")
def row_merge_cells(spark, d):
    dead = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.when(dead, "tombstone").otherwise("cell").alias("kind"), (F.col("event_id") % 4).alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("value"))
    return compact.merge_cells(rows)


@query(f"WITH {MUT}, w AS (SELECT key % 10 AS part, sum(CAST(op = 'DEL' AS INT)) OVER (PARTITION BY key % 10 ORDER BY key, seqno DESC ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS near FROM mut) SELECT part, CAST(max(near) AS BIGINT) AS most, max(near) >= 6 AS fires FROM w GROUP BY part")
def deletion_trigger(spark, d):
    return compact.deletion_trigger(_log(spark, d).withColumn("part", F.col("key") % 10), 10, 6)


@query("SELECT o_orderkey AS key, o_orderkey % 4 AS run, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def rank_merge(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 4).alias("run"))
    return skipping.merge_runs(*[keys.where(F.col("run") == r) for r in range(4)])


_H = """h(k, s) AS (SELECT o_orderkey, s FROM orders, (SELECT range AS s FROM range(1, 5))),
h1 AS (SELECT k, s, xor(CAST(k AS UBIGINT), CAST((s::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)) AS x FROM h),
h2 AS (SELECT k, s, CAST((xor(x, x >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h1),
h3 AS (SELECT k, s, CAST((xor(x, x >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h2),
slots AS (SELECT k, s, CAST((xor(x, x >> 33) & 4294967295::UBIGINT) % 1280 AS BIGINT) AS slot FROM h3)"""
_BLOCK, _BITS, _PROBES = 128, 10, 4


def _blocks(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return skipping.merge_runs(keys.where("key % 2 = 0"), keys.where("key % 2 = 1"))


@query(f"WITH {_H}, p AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // {_BLOCK} AS block FROM orders), b AS (SELECT DISTINCT block, slot FROM slots JOIN p USING (k)) SELECT block, slot // 8 AS byte, CAST(sum(1 << (slot % 8)) AS INT) AS bits FROM b GROUP BY 1, 2")
def bloom_build(spark, d):
    return skipping.bloom_blocks(_blocks(spark, d), _BLOCK, _BITS, _PROBES)


@query(
    f"""WITH {_H.replace("SELECT o_orderkey, s FROM orders,", "SELECT o_orderkey, s FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 100000000 FROM orders),")},
p AS (SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1) // {_BLOCK} AS block FROM orders),
b AS (SELECT DISTINCT block, slot FROM slots JOIN p USING (k)),
q AS (SELECT k + 100000000 AS k, block FROM p UNION ALL SELECT k, block FROM p),
r AS (SELECT q.k, bool_and(b.slot IS NOT NULL) AS hit FROM q JOIN slots USING (k) LEFT JOIN b ON b.block = q.block AND b.slot = slots.slot GROUP BY q.k)
SELECT k >= 100000000 AS foreign_key, count(*) AS asked, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS positive, round(pow(1 - exp(-4 / 10.0::DOUBLE), 4), 9) AS theory FROM r GROUP BY 1"""
)
def bloom_fpr(spark, d):
    ordered = _blocks(spark, d)
    filters = skipping.bloom_blocks(ordered, _BLOCK, _BITS, _PROBES)
    own = ordered.select(F.floor(F.col("position") / _BLOCK).alias("block"), "key")
    asked = own.unionByName(own.withColumn("key", F.col("key") + 100_000_000))
    found = skipping.bloom_probe(filters, asked, _BLOCK, _BITS, _PROBES)
    return found.groupBy((F.col("key") >= 100_000_000).alias("foreign_key")).agg(F.count("*").alias("asked"), F.sum(F.col("may_contain").cast("int")).alias("positive"), F.lit(round((1 - math.exp(-_PROBES / _BITS)) ** _PROBES, 9)).alias("theory"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS file, count(*) AS rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1 HAVING max(o_totalprice) >= 400000 AND min(o_totalprice) <= 500000")
def minmax_skip(spark, d):
    orders = table(spark, d, "orders").withColumn("file", F.date_format("o_orderdate", "yyyy-MM"))
    return skipping.may_match(skipping.zone_map(orders, "file", "o_orderkey", "o_totalprice"), "o_totalprice", 400_000, 500_000)


@query("WITH m AS (SELECT event_id AS seqno, epoch_us(ts) AS ts FROM events WHERE event_id % 100 = 3), a AS (SELECT event_id AS id, epoch_us(ts) AS ts FROM events WHERE event_id % 37 = 0) SELECT id, a.ts, max(seqno) AS seqno FROM a LEFT JOIN m ON m.ts <= a.ts GROUP BY id, a.ts")
def seqno_time_lookup(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return resolve.seqno_of_time(e.where("event_id % 100 = 3").select(F.col("event_id").alias("seqno"), "ts"), e.where("event_id % 37 = 0").select(F.col("event_id").alias("id"), "ts"))


def _vectors(spark, d):
    v = table(spark, d, "embeddings")
    centroids = v.where("vec_id < 8").select(F.col("vec_id").alias("list_id"), F.col("embedding").alias("centroid"))
    queries = v.where("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return index.assign_lists(v, centroids), centroids, queries


_D = "round(list_reduce(list_transform(list_zip(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2])), lambda x, y: x + y), 4)"
_IVF = f"""c AS (SELECT vec_id AS list_id, embedding AS centroid FROM embeddings WHERE vec_id < 8),
ad AS (SELECT v.vec_id, v.embedding, list_id, {_D.format("v.embedding", "centroid")} AS d FROM embeddings v, c),
lists AS (SELECT vec_id, embedding, list_id FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, list_id) AS n FROM ad) WHERE n = 1),
q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 1),
near AS (SELECT query_id, q, list_id FROM (SELECT q.*, list_id, row_number() OVER (PARTITION BY query_id ORDER BY {_D.format("q", "centroid")}, list_id) AS n FROM q, c) WHERE n <= $P),
f AS (SELECT query_id, vec_id, {_D.format("embedding", "q")} AS distance FROM near JOIN lists USING (list_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM f)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10"""


@query("WITH " + _IVF.replace("$P", "8"))
def knn_exact(spark, d):
    return index.knn(*_vectors(spark, d), k=10, probes=8)


@query("WITH " + _IVF.replace("$P", "3"))
def knn_nprobe(spark, d):
    return index.knn(*_vectors(spark, d), k=10, probes=3)


@query(f"WITH {MUT} SELECT seqno, key, op FROM mut WHERE seqno >= (SELECT max(event_id) * 9 // 10 FROM events)")
def cdc_since(spark, d):
    from logweave.streaming.cdc import updates_since

    log = _log(spark, d)
    start = table(spark, d, "events").agg(F.max("event_id")).first()[0] * 9 // 10
    return updates_since(log, start).select("seqno", "key", "op")


@query("SELECT n_name, substr(n_name, 1, 4) AS capped, CASE WHEN length(n_name) >= 6 THEN substr(n_name, 1, 6) END AS fixed, hex(n_name) AS as_hex FROM nation")
def prefix_functions(spark, d):
    name = F.col("n_name")
    return table(spark, d, "nation").select("n_name", bytesops.capped_prefix(name, 4).alias("capped"), bytesops.fixed_prefix(name, 6).alias("fixed"), F.hex(name).alias("as_hex"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS file, count(*) AS entries, count(DISTINCT l_orderkey) AS keys, min(l_orderkey) AS smallest, max(l_orderkey) AS largest, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def file_properties(spark, d):
    return table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("file")).agg(
        F.count("*").alias("entries"), F.count_distinct("l_orderkey").alias("keys"), F.min("l_orderkey").alias("smallest"), F.max("l_orderkey").alias("largest"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents")
    )


@query(f"WITH {MUT}, c AS (SELECT key, seqno, 'k' AS name, k AS value FROM mut WHERE op = 'ENTITY' UNION ALL SELECT key, seqno, 'v' || k % 3, value FROM mut WHERE op = 'ENTITY') SELECT key, name, arg_max(value, seqno) AS value FROM c WHERE value IS NOT NULL GROUP BY key, name")
def wide_merge(spark, d):
    m = mutations(spark, d).where("op = 'ENTITY'")
    cells = F.array(F.struct(F.lit("k").alias("name"), F.col("k").alias("value")), F.struct(F.concat(F.lit("v"), (F.col("k") % 3).cast("string")).alias("name"), F.col("value").alias("value")))
    return merge_ops.wide_merge(m.select("key", "seqno", F.explode(cells).alias("c")).select("key", "seqno", "c.name", "c.value").where("value IS NOT NULL"))


@query(f"WITH {MUT} SELECT key, CAST(sum(value) AS BIGINT) AS value, 1700000000::BIGINT AS write_unix_time FROM mut WHERE op = 'MERGE' GROUP BY key")
def ttl_merge(spark, d):
    return merge_ops.ttl_merge(merge_ops.uint64add(), 1_700_000_000)(_log(spark, d).where("op = 'MERGE'").select("key", "seqno", "value"))


@query("WITH f AS (SELECT o_custkey % 4 AS level, count(*) AS size FROM orders GROUP BY o_custkey), b AS (SELECT level, count(*) AS files, sum(size) AS bytes FROM f GROUP BY level) SELECT level, round(CASE WHEN level = 0 THEN files / 4 ELSE bytes / (1000.0::DOUBLE * pow(10.0::DOUBLE, level - 1)) END, 6) AS score FROM b")
def level_scores(spark, d):
    files = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("size")).select((F.col("o_custkey") % 4).alias("level"), "size")
    return compact.level_scores(files, 1000, 10, 4)


@query("WITH z AS (SELECT o_custkey % 50 AS file, count(*) AS rows, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1) SELECT file, rows FROM z WHERE NOT (lo >= 2000 AND hi <= 480000)")
def delete_files_in_range(spark, d):
    zones = skipping.zone_map(table(spark, d, "orders").withColumn("file", F.col("o_custkey") % 50), "file", "o_totalprice")
    return compact.delete_files_in_range(zones, "o_totalprice", 2000, 480_000).select("file", "rows")


@query("WITH l AS (SELECT event_id AS seqno, epoch_us(ts) // 1000000 AS t FROM events), n AS (SELECT max(t) AS now FROM l) SELECT CASE WHEN t >= now - 864000 THEN 'hot' ELSE 'cold' END AS tier, count(*) AS entries FROM l, n GROUP BY 1")
def tier_by_age(spark, d):
    log = table(spark, d, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("write_unix_time"))
    now = log.agg(F.max("write_unix_time")).first()[0]
    return compact.tier_by_age(log, now, 864_000).groupBy("tier").agg(F.count("*").alias("entries"))


@query(f"WITH {MUT}, s AS (SELECT min(seqno) AS s FROM mut WHERE value > 9000 AND seqno > 100) SELECT key, seqno FROM mut, s WHERE (s IS NULL OR seqno < s) AND op <> 'DEL'")
def recovery_filter(spark, d):
    return compact.recovery_filter(_log(spark, d), F.col("op") == "DEL", (F.col("value") > 9000) & (F.col("seqno") > 100)).select("key", "seqno")


@query("WITH f AS (SELECT o_custkey % 8 AS file, count(*) AS keys, count(*) / 1000.0::DOUBLE AS mb FROM orders GROUP BY 1), t AS (SELECT sum(keys) AS keys, sum(mb) AS mb FROM f) SELECT CAST(keys AS BIGINT) AS keys, CAST(ceil(keys / 4096) AS BIGINT) AS rounds, round(mb / 200.0::DOUBLE, 6) AS io_s, round(keys / 40000.0::DOUBLE, 6) AS merge_s, round(keys / (mb / 200.0::DOUBLE + keys / 40000.0::DOUBLE), 3) AS keys_per_s FROM t")
def merge_cost(spark, d):
    files = table(spark, d, "orders").groupBy((F.col("o_custkey") % 8).alias("file")).agg(F.count("*").alias("keys"), (F.count("*") / 1000.0).alias("mb"))
    return compact.merge_cost(files, 200.0, 40_000.0, 4096)


@query("SELECT n_nationkey AS key, n_name AS value FROM nation UNION ALL SELECT NULL, NULL WHERE false")
def entity_scan(spark, d):
    """Nations as entities, read column by column and put together again."""
    nation = table(spark, d, "nation")
    state = nation.select(F.col("n_nationkey").alias("key"), F.lit(None).cast("string").alias("value"), F.create_map(F.lit("name"), F.col("n_name")).alias("columns"))
    return state.select("key", F.explode("columns").alias("name", "value")).select("key", "value")

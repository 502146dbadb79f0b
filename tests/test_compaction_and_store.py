import random

import duckdb
import pytest
from logweave import catalogue
from logweave.functions import bytesops
from logweave.operators import cache, compact, merge_ops, resolve, scan
from logweave.plans import intervals
from logweave.schema import LOG_SCHEMA
from logweave.sources.batch import WriteBatch
from logweave.sources.store import Busy, Follower, Store, read_file
from logweave.sources.transaction import Conflict, Transaction
from logweave.streaming import cdc
from pyspark.sql import functions as F
from test_engine import LOG, model, random_log


def values(df):
    return {r.key: r.value for r in df.collect()}


@pytest.mark.parametrize(("seed", "few"), [(5, 10_000), (6, 0)])
def test_compaction_with_range_tombstones_changes_no_read(spark, seed, few, monkeypatch):
    monkeypatch.setattr(resolve, "BROADCAST_TOMBSTONES", few)
    rows = random_log(seed, n=240)
    log, add = spark.createDataFrame(rows, LOG), merge_ops.uint64add()
    snapshots = [60, 150] if few else [150]
    for bottom in (False, True) if few else (True,):
        small = compact.compact(log, snapshots, add, bottom)
        small = spark.createDataFrame(small.collect(), small.schema)
        assert small.columns == log.columns and small.count() < log.count()
        monkeypatch.undo()
        for at in (*snapshots, 240):
            assert values(resolve.resolve(small, as_of_seq=at, merge=add)) == model(rows, at)
    assert not compact.compact(log, [], add, True).where("op IN ('RDEL', 'MERGE', 'DEL')").count()


def test_single_deletes_go_with_their_put(spark):
    rows = [(1, 1, "PUT", 5), (1, 2, "SDEL", None), (2, 1, "PUT", 5), (2, 12, "SDEL", None), (3, 3, "SDEL", None), (4, 1, "PUT", 1), (4, 13, "PUT", 1), (4, 14, "SDEL", None)]
    log = spark.createDataFrame(rows, "key int, seqno int, op string, value int")
    left = {(r.key, r.seqno) for r in compact.compact_stripes(log, [10]).collect()}
    assert left == {(2, 1), (2, 12), (3, 3), (4, 1), (4, 14)}


def test_deletions_that_hide_nothing_below(spark):
    log = spark.createDataFrame([(k, 1, "DEL", 0) for k in range(40)], "key int, seqno int, op string, stripe int")
    below = spark.createDataFrame([(0, 30), (5, 6), (35, 36)], "smallest int, largest int")
    want = {*range(31), 35, 36}
    assert {r.key for r in compact.drop_absent_below(log, below).collect()} == want


def test_absent_below_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BROADCAST_TOMBSTONES", 0)
    test_deletions_that_hide_nothing_below(spark)


def test_query_of_absent_below_has_files_for_all_keys(spark, tmp_path):
    """Keys of any size and sign against the query's SQL; a count of files that was fixed missed those over 20,000."""
    kinds = ["error", "click", "view", "error", "signup"]
    rows = [(i, i, key, kinds[(i * 7 + i // 11) % 5], 1.5, '{"k": 1}') for i, key in enumerate([*range(-60, 60), *range(19_990, 20_090), *range(5_000_000, 5_000_060)] * 3)]
    spark.createDataFrame(rows, "event_id bigint, t bigint, user_id bigint, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(2_000).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.sql(catalogue.ORACLE_SQL["drop_absent_below"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["drop_absent_below"](spark, str(tmp_path)).collect())) == want
    assert {r[0] for r in want if r[2] == "DEL" and r[3] == 0 and r[0] > 20_024}


def test_decisions_against_a_loop(spark):
    rnd = random.Random(2)
    rows = [(k, 1, "PUT", rnd.randrange(100)) for k in sorted(rnd.sample(range(300), 200))]
    want, skip = {}, -1
    for k, _, _, v in rows:
        if k < skip:
            continue
        if v < 10:
            want[k] = ("DEL", None)
        elif v < 20:
            want[k] = ("SDEL", None)
        elif v < 30:
            want[k] = ("PUT", v + 1000)
        elif v < 50 and v % 3:
            skip = k + v - 25
        else:
            want[k] = ("PUT", v)
    v = F.col("value")
    decision = F.when(v < 10, compact.REMOVE).when(v < 20, compact.PURGE).when(v < 30, compact.CHANGE_VALUE).when((v < 50) & (v % 3 != 0), compact.SKIP_UNTIL)
    out = compact.apply_decisions(spark.createDataFrame(rows, "key int, seqno int, op string, value int"), decision, v + 1000, until=F.col("key") + v - 25)
    assert {r.key: (r.op, r.value) for r in out.collect()} == want
    empty = compact.remove_empty_values(spark.createDataFrame([(1, "PUT", b""), (2, "PUT", b"x")], "key int, op string, value binary"))
    assert {r.key: r.op for r in empty.collect()} == {1: "DEL", 2: "PUT"}


def test_pickers(spark):
    files = spark.createDataFrame([(0, i, 5, 0, 9) for i in range(5)] + [(1, 10, 50, 0, 4), (1, 11, 50, 5, 8), (1, 12, 20, 20, 30), (2, 20, 10, 6, 25)], "level int, file_id int, size int, smallest int, largest int")
    assert {(r.file_id, r.role) for r in compact.pick_level(files, 1000, 10, 4).collect()} == {(0, "input"), (1, "input"), (2, "input"), (3, "input"), (4, "input"), (10, "overlap"), (11, "overlap")}
    upper = files.where("level > 0")
    assert {(r.file_id, r.role) for r in compact.pick_level(upper, 100, 10, 4, cursor=0).collect()} == {(11, "input"), (20, "overlap")}
    assert {(r.file_id, r.role) for r in compact.pick_level(upper, 100, 10, 4, cursor=99).collect()} == {(10, "input")}
    assert compact.pick_level(upper, 10_000, 10, 4).count() == 0
    assert compact.pick_universal([(1, 1), (2, 1)]) == ("", [])
    assert compact.pick_universal([(1, 50), (2, 60), (3, 70), (4, 50)])[0] == "size amplification"
    assert compact.pick_universal([(1, 10), (2, 10), (3, 20), (4, 500)]) == ("size ratio", [1, 2, 3])
    assert compact.pick_universal([(1, 1), (2, 10), (3, 100), (4, 1000)], amplification=10_000) == ("run count", [1, 2])


def test_byte_operators_in_a_store(spark, tmp_path):
    le = lambda n: n.to_bytes(8, "little")
    cases = {
        "uint64add": ([le(10), le((1 << 64) - 5), b"xx", le(7)], le(12)),
        "bytesxor": ([b"\x0f\x01", b"\xf0", b"\x00\x00\xff" + b"\x01" * 20], b"\xff\x01\xff" + b"\x01" * 20),
        "sortlist": ([b"5,9", b"1", b"7,7"], b"1,5,7,7,9"),
        "mul": ([b"9007199254740993", b"1", b"3"], b"27021597764222979"),
        "last3": ([b"a", b"b", b"c", b"d"], b"d,c,b"),
        "stringappend": ([b"a", b"b", b"c"], b"a,b,c"),
        "max": ([b"a", b"c", b"b"], b"c"),
        "put": ([b"a", b"c", b"b"], b"b"),
    }
    for name, (operands, want) in cases.items():
        rows = [(b"k", i, "MERGE" if i else "PUT", o) for i, o in enumerate(operands)] + [(b"alone", 0, "MERGE", operands[0])]
        log = spark.createDataFrame(rows, "key binary, seqno bigint, op string, value binary").coalesce(1)
        read = resolve.resolve(log, merge=merge_ops.REGISTRY[name]())
        assert {bytes(r.key): bytes(r.value) for r in read.collect()}[b"k"] == want, name
        assert read.schema["value"].dataType == LOG_SCHEMA["value"].dataType
    store = Store(spark, f"file://{tmp_path}/db", merge=merge_ops.uint64add())
    store.write(WriteBatch().put(b"k", le(1)).merge(b"k", le((1 << 64) - 1)).merge(b"x", le(5)))
    store.compact()
    store.write(WriteBatch().merge(b"k", le(3)))
    assert {bytes(r.key): bytes(r.value) for r in store.read().collect()} == {b"k": le(3), b"x": le(5)}
    bare = Store(spark, f"file://{tmp_path}/bare")
    bare.write(WriteBatch().merge(b"k", b"1"))
    with pytest.raises(Exception, match="merge operator"):
        bare.read().collect()


def test_integers_wrap_and_multiply_exactly(spark):
    rows = [(1, 1, "PUT", (1 << 63) - 1), (1, 2, "MERGE", 2), (2, 1, "PUT", (1 << 53) + 1), (2, 2, "MERGE", 1)]
    log = spark.createDataFrame(rows, "key int, seqno int, op string, value bigint")
    assert values(resolve.resolve(log, merge=merge_ops.uint64add()))[1] == -(1 << 63) + 1
    assert int(values(resolve.resolve(log.where("key = 2"), merge=merge_ops.product()))[2]) == (1 << 53) + 1


def test_families_writers_followers_and_listeners(spark, tmp_path):
    path, told = f"file://{tmp_path}/db", []
    store = Store(spark, path, merge=merge_ops.stringappend(), listeners=[lambda event, facts: told.append(event)])
    store.write(WriteBatch("a").put(b"k", b"1").delete_range(b"x", b"z"))
    store.write(WriteBatch("b").put(b"k", b"2").put(b"y", b"3"), now=99)
    follower = Follower(store)
    assert {(r.cf, bytes(r.key)) for r in store.read().collect()} == {("a", b"k"), ("b", b"k"), ("b", b"y")}
    number, first = store.claim(2)
    assert store.latest_seqno() == first + 1 and store.pending(number + 1) == [number]
    with pytest.raises(Busy):
        store.compact()
    txn = Transaction(store)
    txn.put(b"q", b"1")
    with pytest.raises(Conflict):
        txn.commit()
    store.abandon(number)
    store.write(WriteBatch("a").merge(b"k", b"9"))
    assert follower.read().count() == 3 and follower.catch_up() >= 1
    assert {bytes(r.value) for r in follower.read().where("cf = 'a'").collect()} == {b"1,9"}
    before = {(r.cf, bytes(r.key), bytes(r.value)) for r in store.read().collect()}
    store.compact(b"a", b"l")
    store.compact()
    assert {(r.cf, bytes(r.key), bytes(r.value)) for r in store.read().collect()} == before
    assert store.vacuum() and {(r.cf, bytes(r.key), bytes(r.value)) for r in store.read().collect()} == before
    store.export_family("b", f"file://{tmp_path}/export")
    other = Store(spark, f"file://{tmp_path}/other")
    other.import_family(f"file://{tmp_path}/export", "c")
    assert {(r.cf, bytes(r.key)) for r in other.read().collect()} == {("c", b"k"), ("c", b"y")}
    with pytest.raises(ValueError, match="exists"):
        other.import_family(f"file://{tmp_path}/export", "c")
    files = store.files(deletions=F.count_if(F.col("op") == "DEL")).cache()
    assert files.agg(F.sum("entries")).first()[0] == store.log().count()
    assert store.range_log(files, lo=b"y").where("key >= 'y'").count() == store.log().where("key >= 'y'").count()
    name = files.first().file
    assert read_file(spark, name).count() == files.first().entries
    assert {"commit", "compaction"} <= set(told)
    its = scan.new_iterators(store.log(), ["a", "b"], merge=merge_ops.stringappend())
    assert [bytes(r.key) for r in its["b"].collect()] == [b"k", b"y"]


def test_commit_timestamps_and_replayed_batches(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    txn = Transaction(store)
    txn.put(b"a", b"1")
    txn.single_delete(b"b")
    txn.set_commit_timestamp(77)
    txn.commit()
    assert {r.ts for r in store.log().collect()} == {77}
    seen = []

    class Handler:
        def put(self, cf, key, value):
            seen.append((cf, key, value))

        def delete_range(self, cf, key, end):
            seen.append((cf, key, end))

    WriteBatch("f").put(b"a", b"1").delete_range(b"b", b"c").replay(Handler())
    assert seen == [("f", b"a", b"1"), ("f", b"b", b"c")]
    with pytest.raises(AttributeError):
        WriteBatch().merge(b"a", b"1").replay(Handler())


def test_tail_keeps_operands_and_range_tombstones(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "PUT", 10, None), (1, 2, "MERGE", 5, None), (2, 3, "PUT", 1, None), (2, 4, "RDEL", None, 3), (1, 5, "MERGE", 7, None)], LOG)
    for i in range(1, 6):
        log.where(F.col("seqno") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = cdc.tail_state(spark, str(tmp_path / "log"), log.schema, merge=merge_ops.uint64add())
    assert values(stream) == {1: 22}


def test_spans_over_points(spark):
    rnd = random.Random(1)
    spans = [(i, a, a + rnd.randrange(-1, 60) if i % 7 else None) for i in range(60) for a in [rnd.randrange(200)]]
    points = [rnd.randrange(-5, 260) for _ in range(80)]
    want = {(p, i) for p in points for i, lo, hi in spans if p >= lo and (hi is None or p < hi)}
    got = intervals.spans_over(spark.createDataFrame([(p,) for p in points], "key int"), spark.createDataFrame(spans, "id int, lo int, hi int"))
    rows = [tuple(r) for r in got.select("key", "id").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_codecs(spark):
    numbers = [0, 1, 127, 128, 300, (1 << 62) + 5]
    df = spark.createDataFrame([(n, bytes([n & 255, 255])) for n in numbers], "n bigint, b binary")
    out = df.select("n", "b", bytesops.varint_column(F.col("n")).alias("v"), bytesops.upper_bound_column(F.col("b")).alias("u"), bytesops.length_prefixed_column(F.col("b")).alias("l"), bytesops.to_u64_le(F.col("n")).alias("t")).collect()
    for r in out:
        assert bytes(r.v) == bytesops.varint(r.n) and bytes(r.l) == bytesops.length_prefixed(bytes(r.b)) and bytes(r.t) == r.n.to_bytes(8, "little")
        assert (None if r.u is None else bytes(r.u)) == bytesops.prefix_upper_bound(bytes(r.b))


def plain_cache(policy, capacity, rows):
    """Unit-size caches by a scan over all held blocks."""
    held, hits = {}, 0
    for now, (block, _) in enumerate(rows):
        if block in held:
            hits += 1
            n, first, _ = held[block]
            held[block] = (n + 1, first, now)
            continue
        if len(held) == capacity:
            order = {"lru": lambda b: held[b][2], "fifo": lambda b: held[b][1], "mru": lambda b: -held[b][2], "lfu": lambda b: (held[b][0], held[b][2])}[policy]
            del held[min(held, key=order)]
        held[block] = (1, now, now)
    return hits


def test_cache_policies_against_plain_ones():
    rnd = random.Random(4)
    rows = [(min(rnd.randrange(40), rnd.randrange(40)), 1) for _ in range(1500)]
    for capacity in (3, 8, 20):
        for policy in ("lru", "fifo", "mru", "lfu"):
            assert cache.POLICIES[policy](capacity, iter(rows)) == plain_cache(policy, capacity, rows)
        best = cache.POLICIES["opt"](capacity, iter(rows))
        for name, policy in cache.POLICIES.items():
            assert 0 < policy(capacity, iter(rows)) <= best, name
            assert policy(capacity, iter([(1, 0), (1, 0), (2, 99)])) == 0
    assert cache.POLICIES["gdsize"](10, iter([(1, 1), (2, 9), (3, 5), (1, 1), (2, 9)])) == 1

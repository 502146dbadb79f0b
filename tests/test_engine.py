import random

import duckdb
import pytest
from logweave import catalogue
from logweave.functions import bytesops
from logweave.operators import cache, compact, families, merge_ops, metrics, resolve
from logweave.plans.ranged import last_known, row_numbers
from logweave.sources.batch import WriteBatch, numbered
from logweave.sources.store import Store, write_sorted
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


def random_log(seed, n=400, keys=25):
    rnd, rows = random.Random(seed), []
    for s in range(1, n + 1):
        op = rnd.choice(["PUT", "PUT", "MERGE", "MERGE", "DEL", "SDEL", "RDEL"] if s % 3 == 0 else ["PUT", "MERGE"])
        k = rnd.randrange(keys)
        rows.append((k, s, op, rnd.randrange(100), k + rnd.randrange(4) if op == "RDEL" else None))
    return rows


def model(rows, at):
    state = {}
    for k, s, op, v, end in rows:
        if s > at:
            break
        if op in ("PUT",):
            state[k] = v
        elif op == "MERGE":
            state[k] = state.get(k, 0) + v
        elif op == "RDEL":
            for x in range(k, end):
                state.pop(x, None)
        else:
            state.pop(k, None)
    return state


LOG = "key bigint, seqno bigint, op string, value bigint, end_key bigint"


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_against_a_model(spark, seed, monkeypatch):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    for at, most in ((400, 10_000), (230, 0)):
        monkeypatch.setattr(resolve, "BROADCAST_TOMBSTONES", most)
        out = resolve.resolve(log, as_of_seq=at, merge=merge_ops.uint64add())
        assert {r.key: r.value for r in out.collect()} == model(rows, at)


def test_compaction_changes_no_read(spark):
    rows = [r for r in random_log(5) if r[2] != "RDEL"]
    log = spark.createDataFrame(rows, LOG).drop("end_key")
    snapshots = [100, 250]
    striped = compact.compact_stripes(log, snapshots)
    for small in (striped, compact.drop_bottom_deletes(striped)):
        assert small.count() < log.count()
        for at in (*snapshots, 400):
            read = lambda df, at=at: {r.key: r.value for r in resolve.resolve(df, as_of_seq=at, merge=merge_ops.uint64add()).collect()}
            assert read(small.drop("stripe")) == read(log) == model(rows, at)


def test_aggregate_by_name():
    fold = merge_ops.fold_by_name
    assert fold([("sum", "10"), ("sum", "20"), ("sum", "15")]) == ("sum", "45")
    assert fold([("last3", "a,b"), ("last3", "c,d,e"), ("last3", "f")]) == ("last3", "f,c,d")
    assert fold([("", "30"), ("sum", "10"), ("sum", "20")]) == ("sum", "60")
    assert fold([("mul", "10"), ("mul", "20"), ("sum", "30"), ("sum", "40")]) == ("sum", "270")
    assert fold([("mul", "10"), ("mul", "10"), ("mul", "10"), ("sum", "10")]) == ("sum", "1010")
    assert fold([("sum", "1"), ("", "2")])[0] == merge_ops.ERROR
    assert fold([("no", "1")])[0] == merge_ops.ERROR


def test_families_last_one_wins(spark):
    rows = [("key_1", 0, "cf1", "col_1", "foo"), ("key_1", 0, "cf1", "col_2", "baz"), ("key_1", 1, "cf2", "col_2", "quux"), ("key_1", 1, "cf2", "col_3", "bla")]
    cells = spark.createDataFrame(rows, "key string, cf_order int, cf string, name string, value string")
    assert {r.name: r.value for r in families.coalesce_families(cells).collect()} == {"col_1": "foo", "col_2": "quux", "col_3": "bla"}


def test_store_batches_and_snapshots(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    assert store.read().count() == 0
    batch = WriteBatch().put(b"a", b"1").put(b"b", b"2")
    batch.set_save_point()
    batch.delete(b"a")
    batch.rollback_to_save_point()
    first = store.write(batch)
    store.write(WriteBatch().delete_range(b"a", b"b").put_entity(b"c", {"x": b"y", "": b"d"}))
    now = {bytes(r.key): bytes(r.value) for r in store.read().collect()}
    assert now == {b"b": b"2", b"c": b"d"}
    assert {bytes(r.key) for r in store.read(first).collect()} == {b"a", b"b"}
    copy = store.checkpoint(f"file://{tmp_path}/copy", first)
    assert {bytes(r.key) for r in copy.read().collect()} == {b"a", b"b"} and store.files().count() >= 2
    with pytest.raises(ValueError):
        WriteBatch().delete_range(b"b", b"a")
    with pytest.raises(ValueError):
        Store(spark, store.path, as_of=1).write(batch)
    clipped = store.clip(f"file://{tmp_path}/clip", b"b", b"c")
    assert {bytes(r.key) for r in clipped.read().collect()} == {b"b"}


def test_sorted_files_and_numbered_batches(spark, tmp_path):
    rows = spark.range(100).select((99 - F.col("id")).alias("key"), (F.col("id") % 3).alias("batch_id"), F.col("id").alias("pos"))
    write_sorted(rows, str(tmp_path / "s"), 3, bloom_on="key")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100
    n = numbered(rows, 10).orderBy("batch_id", "pos").select("seqno").collect()
    assert [r.seqno for r in n] == list(range(10, 110))


def test_ranged_orders(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(1000), i, rnd.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(4)
    ordered = sorted(rows, key=lambda r: (r[0], r[1]))
    got = {(r.a, r.b): r.n for r in row_numbers(df, "a", "b").collect()}
    assert got == {(a, b): i for i, (a, b, _) in enumerate(ordered, 1)}
    last, want = None, {}
    for a, b, v in ordered:
        last = v if v is not None else last
        want[a, b] = last
    assert {(r.a, r.b): r.found for r in last_known(df, "v", "a", "b", name="found").collect()} == want


def test_bytes():
    assert bytesops.hash64(__import__("numpy").array([0], "u8"), 1)[0] & 0xFFFFFFFF == 2762682090
    for n in (0, 127, 128, 300, 1 << 40):
        assert bytesops.read_varint(b"x" + bytesops.varint(n), 1) == (n, 1 + len(bytesops.varint(n)))
    assert bytesops.prefix_upper_bound(b"a\xff") == b"b" and bytesops.prefix_upper_bound(b"\xff") is None
    assert b"abc" <= bytesops.shortest_separator(b"abc", b"axyz") < b"axyz"
    assert bytesops.xor_bytes(b"\x01\x02", b"\x01") == b"\x00\x02"
    assert bytesops.length_prefixed(b"ab") == b"\x02ab"


def test_cache_policies_agree_with_stack_distance(spark):
    rnd = random.Random(1)
    rows = [(i, i, min(rnd.randrange(30), rnd.randrange(30)), 1, 0) for i in range(600)]
    access = spark.createDataFrame(rows, "ts bigint, seqno bigint, block bigint, size bigint, shard int")
    curve = {r.capacity: r.hits for r in cache.lru_miss_curve(access, "shard", [5, 10]).collect()}
    sim = {(r.policy, r.capacity): r.hits for r in cache.simulate(access, list(cache.POLICIES), [5, 10], "shard").collect()}
    assert curve == {c: sim["lru", c] for c in (5, 10)}
    assert all(sim["opt", c] >= sim[p, c] for p in cache.POLICIES for c in (5, 10))


def test_histogram_limits():
    assert metrics.histogram_bounds(100)[:8] == [1, 2, 3, 4, 6, 10, 15, 22]


def test_plans_push_filters_down(spark):
    plan = catalogue.QUERIES["get_point"](spark, DIR)._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan
    plan = catalogue.QUERIES["range_scan"](spark, DIR)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(c_custkey" in plan

import random

from logweave.operators import families, index, resolve, scan, trace
from logweave.streaming import cdc
from pyspark.sql import functions as F


def test_gaps_and_updates(spark):
    log = spark.createDataFrame([(s, s % 3) for s in (1, 2, 3, 6, 7, 10)], "seqno bigint, key bigint")
    assert sorted(tuple(r) for r in cdc.gaps(log).collect()) == [(3, 6), (7, 10)]
    assert [r.seqno for r in cdc.updates_since(log, 6).collect()] == [6, 7, 10]


def test_windowed_counts_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = cdc.windowed_counts(cdc.stream_log(spark, str(tmp_path / "in"), events.schema), "1 day", "100 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").count()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in want.collect()}


def test_guards(spark):
    log = spark.createDataFrame([(1, s, "MERGE", s) for s in range(5)], "key bigint, seqno bigint, op string, value bigint")
    assert resolve.merge_operands(log).first().operands == [0, 1, 2, 3, 4]
    try:
        resolve.merge_operands(log, most=3).collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "more operands" in str(e)


def test_empty_inputs(spark):
    log = spark.createDataFrame([], "key bigint, seqno bigint, op string, value bigint, end_key bigint")
    assert resolve.resolve(log).count() == 0
    assert scan.multi_get(log, spark.range(2).withColumnRenamed("id", "key")).where("found").count() == 0
    assert trace.key_stats(spark.createDataFrame([], "ts bigint, op string, key bigint, value_size bigint")).count() == 0
    assert families.deadlocks(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "waiter bigint, holder bigint")).count() == 2


WAITS = "waiter bigint, holder bigint"


def on_cycles(rows):
    out, to = set(), {}
    for a, b in rows:
        to.setdefault(a, set()).add(b)
    for a in to:
        seen, stack = set(), [a]
        while stack:
            for b in to.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        out |= {a} & seen
    return out


def test_deadlocks_against_a_search(spark):
    """Components joined by paths of single waiters, cycles of these, self-waits, ends, and nulls, at several densities."""
    rnd, rows = random.Random(3), [(None, 5), (5, None), (7, 7), (7, 8)]
    for base, n, m in ((1_000, 60, 60), (2_000, 60, 75), (3_000, 50, 110)):
        rows += [(base + rnd.randrange(n), base + rnd.randrange(n)) for _ in range(m)]
    rows += [(4_000 + i, 4_000 + (i + 1) % 40) for i in range(40)] + [(4_007, 4_003), (4_020, 4_050), (4_050, 4_051), (4_060, 4_011)]
    got = [r.txn for r in families.deadlocks(spark.createDataFrame(rows, WAITS), trims=1).collect()]
    assert len(got) == len(set(got))
    assert set(got) == on_cycles([r for r in rows if None not in r])


def test_deadlocks_write_few_rows_for_long_cycles(spark, monkeypatch):
    """A cycle of 400 and a path of 400: not all pairs of it, and no round for each edge."""
    made, write = [], families.written

    def counted(df, name="table"):
        out = write(df, name)
        made.append(out.count())
        return out

    monkeypatch.setattr(families, "written", counted)
    rows = [(i, (i + 1) % 400) for i in range(400)] + [(1_000 + i, 1_001 + i) for i in range(400)]
    assert {r.txn for r in families.deadlocks(spark.createDataFrame(rows, WAITS)).collect()} == set(range(400))
    assert sum(made) < 16_000 and len(made) < 20


def test_probing_all_lists_is_exact(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    centroids = v.where("vec_id < 4").select(F.col("vec_id").alias("list_id"), F.col("embedding").alias("centroid"))
    queries = v.where("vec_id = 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = index.knn(index.assign_lists(v, centroids), centroids, queries, 3, 4).orderBy("rank").collect()
    assert got[0].vec_id == 9 and got[0].distance == 0


def test_entities_and_generated_runs(spark):
    from logweave.operators import compact

    state = spark.createDataFrame([(1, None, {"b": "2", "a": "1"}), (2, "v", None)], "key bigint, value string, columns map<string,string>")
    assert [tuple(r) for r in scan.get_entity(state, 1).collect()] == [("a", "1"), ("b", "2")]
    assert [tuple(r) for r in scan.get_entity(state, 2).collect()] == [("", "v")]
    runs = compact.sorted_runs(spark, 4, 100)
    assert runs.count() == runs.select("key").distinct().count() == 400
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, compact.sorted_runs(spark, 4, 100).repartition(3).collect()))

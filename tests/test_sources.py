import pytest
from logweave.sources import dump
from logweave.sources.store import Store
from logweave.sources.transaction import Conflict, Transaction


def test_dumps_round_trip(spark, tmp_path):
    rows = [(b"a\x00\xff", b""), (b"", b"value"), (b"k" * 300, b"v" * 3)]
    df = spark.createDataFrame(rows, "key binary, value binary").repartition(2)
    dump.write_text(df, str(tmp_path / "text"))
    assert sorted((bytes(r.key), bytes(r.value)) for r in dump.read_text(spark, str(tmp_path / "text")).collect()) == sorted(rows)
    dump.register(spark)
    df.write.format("kvdump").mode("append").save(str(tmp_path / "bin"))
    assert sorted((bytes(r.key), bytes(r.value)) for r in spark.read.format("kvdump").load(str(tmp_path / "bin")).collect()) == sorted(rows)


def test_transactions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    first = Transaction(store)
    first.put(b"a", b"1")
    first.commit()
    one, two = Transaction(store), Transaction(store)
    one.put(b"a", b"2")
    one.set_save_point()
    one.delete(b"a")
    assert one.read().count() == 0
    one.rollback_to_save_point()
    assert bytes(one.get_for_update(b"a").first().value) == b"2"
    assert bytes(two.get_for_update(b"a").first().value) == b"1"
    one.commit()
    two.put(b"b", b"3")
    with pytest.raises(Conflict):
        two.commit()
    assert {bytes(r.key): bytes(r.value) for r in store.read().collect()} == {b"a": b"2"}
    two.rollback()
    assert two.commit() == two.snapshot

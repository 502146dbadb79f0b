"""Optimistic transactions over a store: buffered writes, reads of one's own writes, validation at commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.schema import RDEL
from logweave.sources.batch import WriteBatch
from logweave.sources.store import Store


class Conflict(RuntimeError):
    """A tracked key was written after the transaction read it."""


class Transaction:
    """Reads the store as of its begin, with its own batch on top; ``commit`` fails if a tracked key has changed since."""

    def __init__(self, store: Store, cf: str = "default"):
        self.store, self.batch, self.tracked, self.marks = store, WriteBatch(cf), set(), []
        self.ts: int | None = None
        self.folders = store.complete()
        self.snapshot = store.latest_seqno()

    def _track(self, key: bytes) -> None:
        self.tracked.add((self.batch.cf, key))

    def put(self, key: bytes, value: bytes) -> None:
        self._track(key)
        self.batch.put(key, value)

    def put_entity(self, key: bytes, columns: dict[str, bytes]) -> None:
        self._track(key)
        self.batch.put_entity(key, columns)

    def merge(self, key: bytes, operand: bytes) -> None:
        self._track(key)
        self.batch.merge(key, operand)

    def delete(self, key: bytes) -> None:
        self._track(key)
        self.batch.delete(key)

    def single_delete(self, key: bytes) -> None:
        self._track(key)
        self.batch.single_delete(key)

    def delete_range(self, begin: bytes, end: bytes) -> None:
        raise NotImplementedError("a range cannot be tracked key by key")

    def get_for_update(self, key: bytes) -> DataFrame:
        self._track(key)
        return self.read().where(F.col("key") == F.lit(key))

    def undo_get_for_update(self, key: bytes) -> None:
        """Track a key no more, if the transaction has not written it."""
        if all(op[1] != key for op in self.batch.ops):
            self.tracked.discard((self.batch.cf, key))

    def read(self) -> DataFrame:
        """The snapshot with the transaction's own writes over it."""
        base = self.store.log(self.folders).where(F.col("seqno") <= self.snapshot)
        delta = self.batch.to_log(self.store.spark, self.snapshot + 1)
        return self.store.read(log=base.unionByName(delta, allowMissingColumns=True))

    def set_save_point(self) -> None:
        self.batch.set_save_point()
        self.marks.append(set(self.tracked))

    def rollback_to_save_point(self) -> None:
        self.batch.rollback_to_save_point()
        self.tracked = self.marks.pop()

    def rollback(self) -> None:
        self.batch.clear()
        self.tracked.clear()
        self.marks.clear()

    def set_commit_timestamp(self, ts: int) -> None:
        """The timestamp that every write gets at commit."""
        self.ts = ts

    def commit(self) -> int:
        """Write the batch if no tracked key has a newer entry.

        The commit's number is claimed first, and the entries of all earlier numbers are then
        looked at: of two transactions that commit at once the later number sees the earlier
        one's writes.  An earlier commit that is not complete counts as a conflict.  The keys
        are a transaction's own, and few.
        """
        if not self.batch.ops:
            return self.snapshot
        if self.ts is not None:
            self.batch.update_timestamps(self.ts)
        return self.store.write(self.batch, check=self._check)

    def _check(self, number: int) -> None:
        waiting = self.store.pending(number)
        if waiting:
            raise Conflict(f"commits {waiting} are under way")
        log = self.store.log().where(F.col("seqno") > self.snapshot)
        keys = self.store.spark.createDataFrame(sorted(self.tracked), "cf string, key binary")
        points = log.where(F.col("op") != RDEL).join(F.broadcast(keys), ["cf", "key"], "left_semi")
        k = keys.select(F.col("cf").alias("kcf"), F.col("key").alias("k"))
        ranges = log.where(F.col("op") == RDEL).join(F.broadcast(k), (F.col("cf") == F.col("kcf")) & (F.col("key") <= F.col("k")) & (F.col("k") < F.col("end_key")), "left_semi")
        if points.select("seqno").union(ranges.select("seqno")).limit(1).count():
            raise Conflict("a tracked key was written after the snapshot")

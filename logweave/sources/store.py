"""A store: a folder of numbered commits, read at any snapshot.

A writer first claims the next number and its sequence numbers by creating a file that must
not exist yet; so two writers never share any.  A commit is a folder of Parquet files that
counts from the moment Spark's writer marks it as complete.  A compaction is a folder that
stands for all commits up to its number.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweave.operators import compact as compaction
from logweave.operators.merge_ops import MergeOp
from logweave.operators.resolve import resolve
from logweave.operators.skipping import read_matching
from logweave.schema import LOG_SCHEMA, MERGE, RDEL
from logweave.sources.batch import WriteBatch


class Folder:
    """Names and small files below a path, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, jvm = path, spark.sparkContext._jvm
        self.at = jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, inside: str = "") -> list[str]:
        p = self.at(f"{self.path}/{inside}" if inside else self.path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(f"{self.path}/{name}"))

    def create(self, name: str, text: str) -> bool:
        """Create a file with a text; False if there is one."""
        try:
            out = self.fs.create(self.at(f"{self.path}/{name}"), False)
        except Exception:
            if self.exists(name):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def read(self, name: str) -> str:
        p = self.at(f"{self.path}/{name}")
        size = self.fs.getFileStatus(p).getLen()
        stream = self.fs.open(p)
        data = bytes(stream.read() for _ in range(size))
        stream.close()
        return data.decode()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(f"{self.path}/{name}"), True)


class Busy(RuntimeError):
    """Another commit has been claimed and is not complete."""


class Store:
    """One log below ``path``.

    ``as_of`` fixes the newest seqno that is read, which also makes the store read-only.
    listeners are called with an event's name and facts: commit, ingest, compaction, error.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType = LOG_SCHEMA, merge: MergeOp | None = None, as_of: int | None = None, listeners: list[Callable[[str, dict], None]] | None = None):
        self.spark, self.path, self.schema, self.merge, self.as_of = spark, path.rstrip("/"), schema, merge, as_of
        self.listeners = listeners or []
        self.folder = Folder(spark, self.path)

    def _tell(self, event: str, **facts) -> None:
        for f in self.listeners:
            f(event, facts)

    # commits

    def claims(self) -> dict[int, tuple[int, int]]:
        """First seqno and number of seqnos of the newest claim, by its number."""
        names = self.folder.names("claims")
        if not names:
            return {}
        for _ in range(1000):
            text = self.folder.read(f"claims/{names[-1]}").split()
            if len(text) == 2:
                return {int(names[-1]): (int(text[0]), int(text[1]))}
            time.sleep(0.01)  # created, not yet written
        raise Busy(f"claim {names[-1]} was never written")

    def claim(self, count: int) -> tuple[int, int]:
        """The next commit's number and the first of its ``count`` seqnos."""
        while True:
            number, (first, taken) = next(iter(self.claims().items()), (0, (1, 0)))
            if self.folder.create(f"claims/{number + 1:020d}", f"{first + taken} {count}"):
                return number + 1, first + taken

    def complete(self) -> list[str]:
        """Folders that make up the log: the newest compaction and the commits after it."""
        done = [n for n in self.folder.names() if n.startswith(("commit-", "base-")) and self.folder.exists(f"{n}/_SUCCESS")]
        base = max((n for n in done if n.startswith("base-")), default=None)
        after = int(base.split("-")[1]) if base else 0
        return ([base] if base else []) + [n for n in done if n.startswith("commit-") and int(n.split("-")[1]) > after]

    def pending(self, below: int) -> list[int]:
        """Claimed numbers below one whose commit is not complete."""
        base = max((int(n.split("-")[1]) for n in self.folder.names() if n.startswith("base-") and self.folder.exists(f"{n}/_SUCCESS")), default=0)
        return [int(n) for n in self.folder.names("claims") if base < int(n) < below and not self.folder.exists(f"commit-{n}/_SUCCESS")]

    def abandon(self, number: int) -> None:
        """Mark a claimed commit as complete without rows, for one whose writer is gone."""
        self.folder.create(f"commit-{number:020d}/_SUCCESS", "")

    def _commit(self, number: int, rows: DataFrame) -> None:
        """Write a claimed commit, sorted by key within each file so that file statistics narrow scans."""
        try:
            rows.select(*self.schema.names).sortWithinPartitions("key", F.desc("seqno")).write.mode("overwrite").parquet(f"{self.path}/commit-{number:020d}")
        except Exception as e:
            self._tell("error", number=number, error=str(e))
            self.abandon(number)
            raise

    def _writable(self) -> None:
        if self.as_of is not None:
            raise ValueError("a store opened at a snapshot is read-only")

    def latest_seqno(self) -> int:
        """The newest seqno that was claimed; no row is read."""
        first, count = next(iter(self.claims().values()), (1, 0))
        return first + count - 1

    def append(self, rows: DataFrame) -> None:
        """Commit log rows that bring their own seqnos; later writes get larger ones."""
        self._writable()
        top = rows.agg(F.max("seqno")).first()[0] or 0
        number, _ = self.claim(max(0, top - self.latest_seqno()))
        self._commit(number, rows)
        self._tell("commit", number=number, seqno=top)

    def write(self, batch: WriteBatch, now: int | None = None, check: Callable[[int], None] | None = None) -> int:
        """Commit a batch; the seqno of its last operation.

        now: the write time of operations without one.  check: called with the claimed
        number before anything is written; if it raises, the commit is given up.
        """
        self._writable()
        number, base = self.claim(len(batch.ops))
        try:
            if check is not None:
                check(number)
        except Exception:
            self.abandon(number)
            raise
        rows = batch.to_log(self.spark, base)
        if now is not None:
            rows = rows.withColumn("write_unix_time", F.coalesce("write_unix_time", F.lit(now).cast("long")))
        self._commit(number, rows)
        self._tell("commit", number=number, seqno=base + len(batch.ops) - 1)
        return base + len(batch.ops) - 1

    # reads

    def log(self, folders: list[str] | None = None) -> DataFrame:
        """All entries; an empty log where nothing was written."""
        found = self.complete() if folders is None else folders
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in found])

    def read(self, as_of_seq: int | None = None, log: DataFrame | None = None, **how) -> DataFrame:
        """Resolved rows at a snapshot, by family and key, in one pass over all families.

        A log with operands cannot be read without a merge operator.
        """
        at = as_of_seq if as_of_seq is not None else self.as_of
        log = self.log() if log is None else log
        if self.merge is None:
            refused = F.raise_error(F.lit("the log has merge operands: open the store with a merge operator"))
            log = log.withColumn("op", F.when(F.col("op") == MERGE, refused.cast("string")).otherwise(F.col("op")))
        return _by_family(log, lambda keyed: resolve(keyed, at, merge=self.merge, **how))

    def checkpoint(self, to: str, as_of_seq: int | None = None) -> Store:
        """A copy of the log as a snapshot sees it."""
        other = Store(self.spark, to, self.schema, self.merge)
        other.append(self.log() if as_of_seq is None else self.log().where(F.col("seqno") <= as_of_seq))
        return other

    def ingest(self, rows: DataFrame, behind: bool = False) -> None:
        """Add external rows under one new seqno, or behind everything else under seqno 0."""
        self._writable()
        number, base = self.claim(0 if behind else 1)
        self._commit(number, rows.withColumn("seqno", F.lit(0 if behind else base).cast("long")))
        self._tell("ingest", number=number, seqno=0 if behind else base)

    def clip(self, to: str, lo, hi) -> Store:
        """A copy with the keys in [lo, hi) only; range tombstones are cut to it."""
        log = self.log()
        if "end_key" in log.columns:
            rdel = F.col("op") == RDEL
            cut = log.where(rdel & (F.col("key") < F.lit(hi)) & (F.col("end_key") > F.lit(lo)))
            cut = cut.withColumn("key", F.greatest("key", F.lit(lo))).withColumn("end_key", F.least("end_key", F.lit(hi)))
            log = log.where(~rdel & (F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi))).unionByName(cut)
        else:
            log = log.where((F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi)))
        other = Store(self.spark, to, self.schema, self.merge)
        other.append(log)
        return other

    def export_family(self, cf: str, to: str) -> None:
        """The entries of a family as Parquet files, for ``import_family`` of another store."""
        self.log().where(F.col("cf") == cf).write.parquet(to)

    def import_family(self, path: str, cf: str) -> None:
        """Add an exported family under a name that is not in use; its entries keep their order and seqnos."""
        if self.log().where(F.col("cf") == cf).limit(1).count():
            raise ValueError(f"family {cf} exists")
        self.append(self.spark.read.schema(self.schema).parquet(path).withColumn("cf", F.lit(cf)))

    # files

    def files(self, **collectors: Column) -> DataFrame:
        """Entries, key, seqno and time range of every file, and one column for each collector, an aggregate over its entries."""
        named = self.log().withColumn("file", F.input_file_name())
        own = [c.alias(n) for n, c in collectors.items()]
        times = [F.min("ts").alias("smallest_ts"), F.max("ts").alias("largest_ts")] if "ts" in named.columns else []
        ranges = [F.max("end_key").alias("largest_end")] if "end_key" in named.columns else []
        return named.groupBy("file").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.min("seqno").alias("smallest_seqno"), F.max("seqno").alias("largest_seqno"), *times, *ranges, *own)

    def range_log(self, files: DataFrame, lo=None, hi=None, from_ts=None, to_ts=None, table_filter: Column | None = None) -> DataFrame:
        """Entries of those files (a kept result of ``files``) that can matter to keys in [lo, hi) and times in [from_ts, to_ts].

        No other file is opened.  A file with range tombstones reaches up to their ends; one
        without times may match any.
        """
        keep = F.lit(True)
        if lo is not None:
            reach = F.greatest("largest", "largest_end") if "largest_end" in files.columns else F.col("largest")
            keep = keep & (reach >= F.lit(lo))
        if hi is not None:
            keep = keep & (F.col("smallest") < F.lit(hi))
        if from_ts is not None:
            keep = keep & (F.col("largest_ts").isNull() | (F.col("largest_ts") >= from_ts))
        if to_ts is not None:
            keep = keep & (F.col("smallest_ts").isNull() | (F.col("smallest_ts") <= to_ts))
        return read_matching(self.spark, files.where(keep), self.schema, table_filter=table_filter)

    def compact(self, lo=None, hi=None, snapshots: list[int] = (), bottom: bool = True, partitions: int = 8, newest_filter=None) -> str:
        """Rewrite the log, its entries with keys in [lo, hi) compacted; reads at the snapshots and of now stay as they are.

        Commits that are claimed meanwhile come after it.  Entries outside the range, and
        range tombstones unless the whole log is compacted, are taken over.
        """
        self._writable()
        number, _ = self.claim(0)
        waiting = self.pending(number)
        if waiting:
            self.abandon(number)
            raise Busy(f"commits {waiting} are not complete")
        log, whole = self.log(), lo is None and hi is None
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col("key") >= F.lit(lo))
        if hi is not None:
            inside = inside & (F.col("key") < F.lit(hi))
        ranges = F.col("op") == RDEL
        part = log.where(inside | ranges)
        out = _by_family(part, lambda keyed: compaction.compact(keyed, list(snapshots), self.merge, bottom, newest_filter))
        if not whole:
            out = out.where(~ranges).unionByName(log.where(ranges)).unionByName(log.where(~inside & ~ranges))
        name = f"base-{number:020d}"
        out.select(*self.schema.names).repartitionByRange(partitions, "key").sortWithinPartitions("key", F.desc("seqno")).write.parquet(f"{self.path}/{name}")
        self._tell("compaction", number=number, folder=name, whole=whole)
        return name

    def vacuum(self) -> list[str]:
        """Delete folders that a compaction stands for; readers that hold them must be done."""
        kept = set(self.complete())
        base = max((n for n in kept if n.startswith("base-")), default=None)
        gone = [n for n in self.folder.names() if n.startswith(("commit-", "base-")) and n not in kept and base and int(n.split("-")[1]) <= int(base.split("-")[1])]
        for n in gone:
            self.folder.delete(n)
        return gone


class Follower:
    """A reader that sees the commits it has caught up with, and no later ones; it never writes."""

    def __init__(self, store: Store):
        self.store = Store(store.spark, store.path, store.schema, store.merge, as_of=1 << 62)
        self.folders: list[str] = []
        self.catch_up()

    def catch_up(self) -> int:
        """Take over what was committed since; the number of new folders.  A gap of an open commit is waited out."""
        found = self.store.complete()
        waiting = self.store.pending(1 << 62)
        if waiting:
            found = [n for n in found if int(n.split("-")[1]) < waiting[0]]
        new = len(set(found) - set(self.folders))
        self.folders = found
        return new

    def read(self, **how) -> DataFrame:
        return self.store.read(log=self.store.log(self.folders), **how)


def _by_family(log: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over a log whose keys are (family, key), so that one plan serves all families."""
    if "cf" not in log.columns:
        return run(log)
    family = F.coalesce("cf", F.lit("default")).alias("cf")
    keyed = log.withColumn("key", F.struct(family, F.col("key").alias("key")))
    if "end_key" in log.columns:
        keyed = keyed.withColumn("end_key", F.when(F.col("end_key").isNotNull(), F.struct(family, F.col("end_key").alias("key"))))
    out = run(keyed.drop("cf"))
    columns = {"key": F.col("key.key"), "cf": F.col("key.cf")}
    if "end_key" in out.columns:
        columns["end_key"] = F.col("end_key.key")
    return out.withColumn("cf", F.col("key.cf")).select(*[columns.get(c, F.col(c)).alias(c) for c in [*out.columns, "cf"]])


def read_file(spark: SparkSession, path: str, schema: StructType = LOG_SCHEMA, lo=None, hi=None) -> DataFrame:
    """Raw entries of one file without a store: tombstones and all versions, by key and newest first."""
    rows = spark.read.schema(schema).parquet(path)
    if lo is not None:
        rows = rows.where(F.col("key") >= F.lit(lo))
    if hi is not None:
        rows = rows.where(F.col("key") < F.lit(hi))
    return rows.orderBy("key", F.desc("seqno"))


def write_sorted(rows: DataFrame, path: str, partitions: int, bloom_on: str | None = None) -> None:
    """Rows in key order over range-partitioned files, with a membership filter on a column if asked for."""
    writer = rows.repartitionByRange(partitions, "key").sortWithinPartitions("key").write
    if bloom_on:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom_on}", "true")
    writer.parquet(path)

"""Written intermediate tables in the cluster's shared folder.

``written(df)`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and
returns the DataFrame that reads it back.  The table replaces the lineage: a lost
executor costs a re-read, not a re-computation, and a result used twice is made
once.  Where the session names no folder (tests, a laptop), one below the
system's temporary folder is set.  After each table the driver's JVM gives back to the
system what its native code has freed.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []
_TRIM, _COMMANDS = "systemTrimNativeHeap", "com.sun.management:type=DiagnosticCommand"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clear)
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> str | None:
    """What the driver's JVM says after giving freed native memory back; None if it has no command for that.

    Plans with many exchanges start hundreds of short-lived threads, and the C library keeps what each of
    them frees in arenas of their own: memory beyond the heap that grows over a long session.
    """
    with contextlib.suppress(Exception):
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)  # without parameters and their types
        args[0], args[1] = jvm.javax.management.ObjectName(_COMMANDS), _TRIM
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    return None


def clear() -> None:
    """Delete what this driver wrote; a stopped session leaves it to the folder's owner."""
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

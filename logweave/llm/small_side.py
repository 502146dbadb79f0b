"""Bounds of what is broadcast, sent to the driver or held in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.scratch import written

#: A side of at most so many narrow rows (ids and small numbers) is broadcast.
BROADCAST_ROWS = 400_000
#: Bytes of texts that go to a Python worker at once, and rows that are folded into one in a round.
BATCH_BYTES, FAN = 4 << 20, 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def join_checked(big: DataFrame, small: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """big joined with small, a written table; broadcast up to ``limit`` rows, else shuffled."""
    few = small.count() <= limit
    return big.join(F.broadcast(small) if few else small, on, how)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (a longer text stands alone), unless the session sets a bound itself."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def folded(rows: DataFrame, run, name: str = "fold") -> DataFrame:
    """A written table of at most one row: run adds up the rows of a task, round by round.

    rows are of bounded size, one for each task of a pass, say; no task ever gets many more than
    ``FAN`` of them, and the driver one.
    """
    rows = written(rows, name)
    n = rows.count()
    while n > 1:
        rows = written(rows.repartition(-(-n // FAN)).mapInArrow(run, rows.schema), name)
        n = rows.count()
    return rows

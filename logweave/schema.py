"""The envelope of a mutation log and its operation names.

A log is any DataFrame with these columns; ``value`` and ``columns`` may have other
types.  ``key`` orders as Spark orders its type (binary: unsigned bytewise).  A larger
``seqno`` is newer; seqnos are unique within a key.
"""

from __future__ import annotations

from pyspark.sql import types as T

PUT, ENTITY, MERGE, DEL, SDEL, RDEL, DELTS = "PUT", "ENTITY", "MERGE", "DEL", "SDEL", "RDEL", "DELTS"
#: Newest entries of these kinds hide a key.
DELETES = (DEL, SDEL, DELTS)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("cf", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("ts", T.LongType()),
        T.StructField("seqno", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("columns", T.MapType(T.StringType(), T.BinaryType())),
        T.StructField("end_key", T.BinaryType()),
        T.StructField("write_unix_time", T.LongType()),
    ]
)

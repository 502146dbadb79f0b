"""Where queries and their SQL are registered, and the log that the events table stands for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The events as mutations of users, in SQL.
MUT = """mut AS (
  SELECT user_id AS key, event_id AS seqno, ts, CAST(round(value * 100) AS BIGINT) AS value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
         CASE event_type WHEN 'signup' THEN 'PUT' WHEN 'click' THEN 'ENTITY' WHEN 'purchase' THEN 'MERGE'
                         WHEN 'view' THEN 'MERGE' ELSE 'DEL' END AS op
  FROM events)"""

#: With the newest entry other than an operand, the operands since, and what is alive.
FOLD = (
    MUT
    + """, base AS (
  SELECT key, max(seqno) AS bs, arg_max(op, seqno) AS bop, arg_max(value, seqno) AS bv, arg_max(k, seqno) AS bk
  FROM mut WHERE op <> 'MERGE' GROUP BY key),
operands AS (SELECT m.* FROM mut m LEFT JOIN base b USING (key) WHERE m.op = 'MERGE' AND m.seqno > coalesce(b.bs, -1)),
alive AS (
  SELECT k.key, CASE WHEN b.bop <> 'DEL' THEN b.bv END AS bv, CASE WHEN b.bop <> 'DEL' THEN b.bk END AS bk, b.bs
  FROM (SELECT DISTINCT key FROM mut) k LEFT JOIN base b USING (key)
  WHERE b.bop <> 'DEL' OR k.key IN (SELECT key FROM operands))"""
)


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a mutation log: key user, seqno event, value in cents."""
    op = F.col("event_type")
    kinds = {"signup": "PUT", "click": "ENTITY", "purchase": "MERGE", "view": "MERGE"}
    named = F.lit("DEL")
    for event, name in kinds.items():
        named = F.when(op == event, name).otherwise(named)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seqno"),
        "ts",
        F.round(F.col("value") * 100).cast("long").alias("value"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
        named.alias("op"),
    )

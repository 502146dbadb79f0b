"""Point reads, cursors and scans over resolved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.resolve import resolve
from logweave.plans import intervals


def get(log: DataFrame, key, **snapshot) -> DataFrame:
    """The row of one key; the key filter reaches the scan, below the resolution."""
    return resolve(log.where((F.col("key") == F.lit(key)) | (F.col("op") == "RDEL")) if "end_key" in log.columns else log.where(F.col("key") == F.lit(key)), **snapshot).where(F.col("key") == F.lit(key))


def multi_get(state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Every asked key with its row or nulls, and ``found``; state has unique keys."""
    return keys.select(key).distinct().join(state.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def range_scan(state: DataFrame, lo=None, hi=None, key: str = "key", reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows with lo <= key < hi in key order."""
    if lo is not None:
        state = state.where(F.col(key) >= F.lit(lo))
    if hi is not None:
        state = state.where(F.col(key) < F.lit(hi))
    out = state.orderBy(F.desc(key) if reverse else F.asc(key))
    return out if limit is None else out.limit(limit)


def seek(state: DataFrame, target, n: int = 1, key: str = "key") -> DataFrame:
    """The first n rows at or after the target."""
    return range_scan(state, lo=target, key=key, limit=n)


def seek_for_prev(state: DataFrame, target, n: int = 1, key: str = "key") -> DataFrame:
    """The last n rows at or before the target, nearest first."""
    return state.where(F.col(key) <= F.lit(target)).orderBy(F.desc(key)).limit(n)


def prefix_scan(state: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows whose text key begins with the prefix, in key order."""
    return state.where(F.col(key).startswith(prefix)).orderBy(key)


def multi_scan(state: DataFrame, ranges: DataFrame, key: str = "key", few: int = 10_000) -> DataFrame:
    """Rows of each range (range_id, lo, hi; a null hi is open) with its range_id.

    Up to ``few`` ranges are broadcast; more meet the keys block by block (``plans.intervals``).
    """
    if ranges.count() > few:
        return state.join(intervals.spans_over(state, ranges.select("range_id", "lo", "hi"), key), key)
    inside = (F.col(key) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(key) < F.col("hi")))
    return state.join(F.broadcast(ranges), inside).drop("lo", "hi")


def multi_get_entity(state: DataFrame, keys: DataFrame, key: str = "key", columns: str = "columns") -> DataFrame:
    """Every asked key with ``found`` and its wide columns as a map; a plain value is the column without a name."""
    kind = state.schema[columns].dataType
    plain = F.map_from_arrays(F.array(F.lit("")), F.array(F.col("value").cast(kind.valueType)))
    entities = state.select(key, F.coalesce(F.col(columns), plain).alias(columns))
    return multi_get(entities, keys, key)


def new_iterators(log: DataFrame, families: list[str], as_of_seq: int | None = None, lo=None, hi=None, **how) -> dict[str, DataFrame]:
    """A scan in key order for each family, all at one snapshot: the newest entry now, if none is given."""
    if as_of_seq is None:
        as_of_seq = log.agg(F.max("seqno")).first()[0]
    parts = {c: log.where(F.col("cf") == c).drop("cf") for c in families}
    return {c: range_scan(resolve(p, as_of_seq=as_of_seq, **how), lo, hi) for c, p in parts.items()}


def key_may_exist(filters: DataFrame, state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Asked keys with ``may_exist``, of filters (slot) over all keys, and ``value_found`` with ``value`` where state has the key.

    filters comes from ``skipping.bloom_of``; a key that the filter rules out is never looked up.
    """
    from logweave.operators.skipping import bloom_test

    tested = bloom_test(filters, keys.select(key).distinct(), key)
    held = state.select(key, "value", F.lit(True).alias("value_found"))
    met = tested.where("may_exist").join(held, key, "left")
    out = met.unionByName(tested.where("NOT may_exist"), allowMissingColumns=True)
    return out.withColumn("value_found", F.coalesce("value_found", F.lit(False)))


def approximate_size(log: DataFrame, lo, hi, key: Column | None = None) -> DataFrame:
    """Entries and bytes of keys and values (as text) in a range."""
    k = key if key is not None else F.col("key")
    part = log.where((k >= F.lit(lo)) & (k < F.lit(hi)))
    return part.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(k.cast("string")) + F.octet_length(F.coalesce(F.col("value").cast("string"), F.lit("")))), F.lit(0)).alias("bytes"))


def get_entity(state: DataFrame, key, columns: str = "columns") -> DataFrame:
    """(name, value) of the wide columns of one key, by name; a plain value is the column without a name."""
    row = state.where(F.col("key") == F.lit(key))
    plain = F.map_from_arrays(F.array(F.lit("")), F.array("value"))
    return row.select(F.explode(F.coalesce(F.col(columns), plain)).alias("name", "value")).orderBy("name")

"""Merge operators: how the operands of a key fold onto its base value.

Each operator is an aggregate over the operands, oldest to newest, that Spark can
partly compute before its shuffle where the fold allows it, and an expression that
puts the base value and the folded operands together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.bytesops import from_u64_le, to_u64_le


@dataclass(frozen=True)
class MergeOp:
    """fold(value, seqno): aggregate over operands; combine(base, folded): the value, with base null where none is.

    binary: the operator of byte values, where these differ; frame: a function of (operands,
    keys) that gives keys and ``folded`` by other means than one aggregate.
    """

    fold: Callable[[Column, Column], Column]
    combine: Callable[[Column, Column], Column]
    binary: MergeOp | None = None
    frame: Callable[[DataFrame, list[str]], DataFrame] | None = None

    def of(self, kind: T.DataType) -> MergeOp:
        return self.binary if self.binary is not None and isinstance(kind, T.BinaryType) else self

    def folded(self, operands: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, folded, merge_seqno) of operands (keys, seqno, value)."""
        if self.frame is None:
            return operands.groupBy(*keys).agg(self.fold(F.col("value"), F.col("seqno")).alias("folded"), F.max("seqno").alias("merge_seqno"))
        newest = operands.groupBy(*keys).agg(F.max("seqno").alias("merge_seqno"))
        return newest.join(self.frame(operands, keys), keys, "left")


def _ordered(value: Column, seqno: Column) -> Column:
    """Operands oldest first, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(seqno.alias("s"), value.alias("v")))), lambda x: x["v"])


_U64 = Decimal(1 << 64)


def uint64add() -> MergeOp:
    """Sums modulo 2**64: of integers as signed numbers, of bytes as eight little-endian bytes (other lengths count as 0)."""

    def wrapped(total: Column) -> Column:
        low = F.pmod(total.cast("decimal(38,0)"), F.lit(_U64))
        return F.when(low >= F.lit(Decimal(1 << 63)), low - F.lit(_U64)).otherwise(low).cast("bigint")

    zero = F.lit(0).cast("decimal(38,0)")
    fold = lambda v, s: F.sum(v.cast("decimal(28,0)"))
    coded = MergeOp(lambda v, s: F.sum(from_u64_le(v)), lambda b, f: to_u64_le(F.pmod(F.coalesce(from_u64_le(b), zero) + F.coalesce(f, zero), F.lit(_U64))))
    return MergeOp(fold, lambda b, f: wrapped(F.coalesce(b.cast("decimal(28,0)"), zero) + F.coalesce(f, zero)), coded)


def maximum() -> MergeOp:
    return MergeOp(lambda v, s: F.max(v), lambda b, f: F.greatest(b, f))


def put() -> MergeOp:
    return MergeOp(lambda v, s: F.max_by(v, s), lambda b, f: F.coalesce(f, b))


def stringappend(delimiter: str = ",") -> MergeOp:
    joined = lambda v, s: F.array_join(_ordered(v.cast("string"), s), delimiter)
    both = lambda b, f: F.concat_ws(delimiter, b.cast("string"), f)
    return MergeOp(joined, both, MergeOp(joined, lambda b, f: both(b, f).cast("binary")))


def sortlist() -> MergeOp:
    """Operands and the base as one sorted list; the base is kept.  Integers give arrays, bytes lists of numbers with commas."""
    none = F.array().cast("array<bigint>")
    numbers = lambda v: F.split(v.cast("string"), ",").cast("array<bigint>")
    text = lambda a: F.array_join(a.cast("array<string>"), ",").cast("binary")
    coded = MergeOp(lambda v, s: F.flatten(F.collect_list(numbers(v))), lambda b, f: text(F.array_sort(F.concat(F.coalesce(numbers(b), none), F.coalesce(f, none)))))
    return MergeOp(lambda v, s: F.collect_list(v), lambda b, f: F.array_sort(F.concat(F.when(b.isNull(), none).otherwise(F.array(b)), F.coalesce(f, none))), coded)


def _xor_frame(operands: DataFrame, keys: list[str]) -> DataFrame:
    """Exclusive or of byte strings, eight bytes at a time; a key's operands meet as partial sums."""
    words = F.ceil(F.octet_length("value") / 8).cast("int")
    at = F.explode(F.when(words > 0, F.sequence(F.lit(0), words - 1)).otherwise(F.array().cast("array<int>")))
    parts = operands.select(*keys, "value", at.alias("i")).select(*keys, "i", F.octet_length("value").alias("n"), F.rpad(F.hex(F.expr("substring(value, 8 * i + 1, 8)")), 16, "0").alias("h"))
    halves = [F.conv(F.substring("h", i, 8), 16, 10).cast("bigint") for i in (1, 9)]
    sums = parts.groupBy(*keys, "i").agg(F.bit_xor(halves[0]).alias("a"), F.bit_xor(halves[1]).alias("b"), F.max("n").alias("n"))
    hexes = F.concat(*[F.lpad(F.hex(c), 8, "0") for c in ("a", "b")])
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", hexes.alias("h")))).alias("w"), F.max("n").alias("n"))
    return whole.select(*keys, F.unhex(F.expr("substring(array_join(transform(w, x -> x.h), ''), 1, 2 * n)")).alias("folded"))


def _xor_values(a: Column, b: Column) -> Column:
    """Bytewise exclusive or of two byte strings, the shorter one extended by zeros."""
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    digits = lambda x: F.rpad(F.hex(x), 2 * n, "0")
    both = F.transform(F.sequence(F.lit(1), n), lambda i: F.lpad(F.hex(F.conv(F.substring(digits(a), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint").bitwiseXOR(F.conv(F.substring(digits(b), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))), 2, "0"))
    return F.when(n > 0, F.unhex(F.array_join(both, ""))).otherwise(a)


def bytesxor() -> MergeOp:
    """Exclusive or of integers, or of byte strings of which shorter ones are extended by zeros."""
    coded = MergeOp(lambda v, s: F.max(v), lambda b, f: F.when(b.isNull(), F.coalesce(f, F.lit(b""))).when(f.isNull(), b).otherwise(_xor_values(b, f)), frame=_xor_frame)
    return MergeOp(lambda v, s: F.bit_xor(v), lambda b, f: F.coalesce(b, F.lit(0)).bitwiseXOR(F.coalesce(f, F.lit(0))), coded)


def product() -> MergeOp:
    """Products, exact to 38 digits, beyond which Spark's overflow error is raised; bytes are numbers in decimal digits."""

    def times(values: Column) -> Column:
        return F.aggregate(values, F.lit(1).cast("decimal(38,0)"), lambda x, y: (x * y.cast("decimal(38,0)")).cast("decimal(38,0)"))

    one = F.lit(1).cast("decimal(38,0)")
    both = lambda b, f: (F.coalesce(b.cast("decimal(38,0)"), one) * F.coalesce(f, one)).cast("decimal(38,0)")
    coded = MergeOp(lambda v, s: times(F.collect_list(v.cast("string"))), lambda b, f: both(b.cast("string"), f).cast("string").cast("binary"))
    return MergeOp(lambda v, s: times(F.collect_list(v)), both, coded)


def last(n: int = 3) -> MergeOp:
    """The newest n operands, newest first; only these are gathered.  Integers give arrays, bytes values with commas."""

    def frame(operands: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seqno")))
        few = operands.withColumn("rank_", rank).where(F.col("rank_") <= n)
        return few.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_", "value"))), lambda x: x["value"]).alias("folded"))

    newest = lambda v, s: F.slice(F.reverse(_ordered(v, s)), 1, n)
    none = F.array().cast("array<bigint>")
    text = lambda b, f: F.array_join(F.slice(F.concat(F.coalesce(f.cast("array<string>"), F.array().cast("array<string>")), F.when(b.isNull(), F.array().cast("array<string>")).otherwise(F.array(b.cast("string")))), 1, n), ",")
    coded = MergeOp(newest, lambda b, f: text(b, f).cast("binary"), frame=frame)
    return MergeOp(newest, lambda b, f: F.slice(F.concat(F.coalesce(f, none), F.when(b.isNull(), none).otherwise(F.array(b))), 1, n), coded, frame)


#: Operators by name.
REGISTRY: dict[str, Callable[..., MergeOp]] = {
    "uint64add": uint64add,
    "max": maximum,
    "put": put,
    "stringappend": stringappend,
    "stringappendtest": stringappend,
    "sortlist": sortlist,
    "bytesxor": bytesxor,
    "mul": product,
    "last3": last,
}

#: Aggregators by name for operands that name their function.
AGGREGATORS: dict[str, Callable[[list], object]] = {
    "sum": lambda xs: sum(int(x) for x in xs),
    "mul": lambda xs: _product(int(x) for x in xs),
    "last3": lambda xs: ",".join([y for x in reversed(xs) for y in str(x).split(",")][:3]),
}
ERROR = "error"


def _product(xs) -> int:
    out = 1
    for x in xs:
        out *= x
    return out


def fold_by_name(operands: list[tuple[str, str]], aggregators: dict[str, Callable[[list], object]] = AGGREGATORS) -> tuple[str, str]:
    """Fold (function, payload) operands, oldest first.

    A run of one function folds together; its result becomes the first value of the next
    run.  Operands without a function join the run that follows them; after a named run
    they are a run of an unknown function.  Any failure gives the error function with all
    payloads.
    """
    name, values = "", []
    try:
        for function, payload in operands:
            if function != name:
                if name:
                    values = [str(aggregators[name](values))]
                name = function
            values.append(payload)
        return name, str(aggregators[name](values))
    except (KeyError, ValueError, TypeError):
        return ERROR, ";".join(f"{f}:{p}" for f, p in operands)


def agg_merge(log: DataFrame) -> DataFrame:
    """(key, function, value) of rows (key, seqno, function, payload): ``fold_by_name`` per key, in seqno order."""

    listed = log.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seqno", "function", "payload"))).alias("operands"))

    @F.pandas_udf("struct<function:string,value:string>")
    def folded(operands: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fold_by_name([(o["function"], o["payload"]) for o in ops]) for ops in operands], columns=["function", "value"])

    return listed.select("key", folded("operands").alias("r")).select("key", "r.function", "r.value")


def wide_merge(cells: DataFrame) -> DataFrame:
    """(key, name, value) of entity operands (key, seqno, name, value): of each column the newest operand's value."""
    return cells.groupBy("key", "name").agg(F.max_by("value", "seqno").alias("value"))


def ttl_merge(inner: MergeOp, now: int) -> Callable[[DataFrame], DataFrame]:
    """A fold of rows (key, seqno, value) whose result is stamped with ``now``: (key, value, write_unix_time)."""

    def run(rows: DataFrame) -> DataFrame:
        folded = rows.groupBy("key").agg(inner.fold(F.col("value"), F.col("seqno")).alias("folded"))
        return folded.select("key", inner.combine(F.lit(None).cast(folded.schema["folded"].dataType), F.col("folded")).alias("value"), F.lit(now).cast("long").alias("write_unix_time"))

    return run

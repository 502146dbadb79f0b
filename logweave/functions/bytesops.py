"""Functions of keys and byte strings, as columns."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_prefix(key: Column, n: int) -> Column:
    """The first n characters or bytes; null for shorter keys, which are out of the domain."""
    return F.when(F.length(key) >= n, F.substring(key, 1, n))


def capped_prefix(key: Column, n: int) -> Column:
    """The first n characters or bytes, or all of a shorter key."""
    return F.substring(key, 1, n)


def segment(key: Column, delimiter: str, i: int) -> Column:
    """The i-th segment (from 0) of a delimited key; null where there is none."""
    return F.try_element_at(F.split(key, delimiter), F.lit(i + 1))


def prefix_upper_bound(prefix: bytes) -> bytes | None:
    """The least byte string above all that begin with the prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def shortest_separator(a: bytes, b: bytes) -> bytes:
    """A short string s with a <= s < b, for a < b."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    if n < min(len(a), len(b)) and a[n] + 1 < b[n]:
        return a[:n] + bytes([a[n] + 1])
    return a


def varint(n: int) -> bytes:
    """Unsigned integer, seven bits a byte, low ones first."""
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The number at a position, and the position after it."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def length_prefixed(data: bytes) -> bytes:
    return varint(len(data)) + data


def from_u64_le(value: Column) -> Column:
    """The number in eight little-endian bytes, as decimal(20,0); 0 for other lengths, null for null."""
    h = F.hex(value)
    swapped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)])
    number = F.conv(swapped, 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(value) == 8, number).when(value.isNotNull(), F.lit(0).cast("decimal(20,0)"))


def to_u64_le(number: Column) -> Column:
    """Eight little-endian bytes of a whole number from 0 to 2**64 - 1."""
    h = F.lpad(F.conv(number.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)]))


def encode_ts(ts: Column) -> Column:
    """A timestamp suffix: eight little-endian bytes of an unsigned number."""
    return to_u64_le(ts)


def split_ts(key: Column) -> tuple[Column, Column]:
    """A key with a timestamp suffix as the key alone and its timestamp; null for keys shorter than the suffix."""
    n = F.octet_length(key)
    return F.when(n >= 8, F.substring(key, F.lit(1), n - 8)), F.when(n >= 8, from_u64_le(F.substring(key, n - 7, F.lit(8))))


def crc32_masked(value: Column) -> Column:
    """CRC-32 of a byte string in the stored form: rotated right by 15 bits, plus a constant, modulo 2**32."""
    c = F.crc32(value)
    turned = F.shiftright(c, 15).bitwiseOR(F.shiftleft(c, 17).bitwiseAND(F.lit((1 << 32) - 1)))
    return (turned + F.lit(0xA282EAD8)).bitwiseAND(F.lit((1 << 32) - 1))  # fixed value


def varint_column(number: Column) -> Column:
    """``varint`` of a column of whole numbers from 0 to 2**63 - 1."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.call_function("shiftrightunsigned", number, (i * 7).cast("int")))
    used = F.filter(groups, lambda x, i: (x > 0) | (i == 0))
    coded = F.transform(used, lambda x, i: F.lpad(F.hex(x.bitwiseAND(F.lit(127)) + F.when(i < F.size(used) - 1, 128).otherwise(0)), 2, "0"))
    return F.unhex(F.array_join(coded, ""))


def length_prefixed_column(value: Column) -> Column:
    return F.concat(varint_column(F.octet_length(value).cast("bigint")), value)


def upper_bound_column(prefix: Column) -> Column:
    """``prefix_upper_bound`` of a column of byte strings: null where there is none."""
    cut = F.regexp_replace(F.hex(prefix), "(FF)+$", "")
    cut = F.when(F.length(cut) % 2 == 0, cut).otherwise(F.concat(cut, F.lit("F")))
    n = F.length(cut)
    step = F.lpad(F.hex(F.conv(F.substring(cut, n - 1, F.lit(2)), 16, 10).cast("bigint") + 1), 2, "0")
    return F.when(n > 0, F.unhex(F.concat(F.substring(cut, F.lit(1), n - 2), step)))


def hash64(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of unsigned keys with a seed; arithmetic wraps."""
    u = np.uint64
    # fixed values: the finaliser's multipliers
    h = x.astype(u) ^ (u(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    h ^= h >> u(33)
    h *= u(0xFF51AFD7ED558CCD)
    h ^= h >> u(33)
    h *= u(0xC4CEB9FE1A85EC53)
    h ^= h >> u(33)
    return h


def bloom_slots(key: Column, width: int, probes: int) -> Column:
    """The slots of a key in a filter of ``width`` bits: for each seed 1.. the low 32 hash bits modulo the width."""

    @F.arrow_udf("array<bigint>")
    def slots(keys: pa.Array) -> pa.Array:
        x = keys.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        at = np.stack([(hash64(x, s) & np.uint64(0xFFFFFFFF)) % np.uint64(width) for s in range(1, probes + 1)], axis=1).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * probes, pa.int32()), pa.array(at.reshape(-1)))

    return slots(key)


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """Bytewise exclusive or, the shorter side extended by zeros."""
    n = max(len(a), len(b))
    return (int.from_bytes(a.ljust(n, b"\0"), "big") ^ int.from_bytes(b.ljust(n, b"\0"), "big")).to_bytes(n, "big")


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays in double precision, added from the first component on."""
    terms = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def first_above(x: Column, bounds: list[int]) -> Column:
    """The first bound strictly greater than x; null above all."""
    return F.try_element_at(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > x), F.lit(1))

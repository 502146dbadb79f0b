"""Packs: named arrays in one compressed binary, by planes of bytes, dealt to buckets."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<B", len(arrays))]
    for x in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros((0, 0), np.uint8)
        parts.append(struct.pack("<3sQ", x.dtype.str[1:].encode().ljust(3), len(x)))
        parts.append(planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<3sQ", data, at)
        dtype = np.dtype("<" + kind.decode().strip())
        at += 11
        size = n * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, count=size, offset=at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
        at += size
    return out


def deal(where: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows) of every bucket that has some."""
    order = np.argsort(where, kind="stable")
    heads = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in range(buckets):
        if heads[b] < heads[b + 1]:
            yield b, order[heads[b] : heads[b + 1]]


def batch_rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "kind": pa.int32(), "pack": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names=names)

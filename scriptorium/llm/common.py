"""Shared pieces of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import cut, spread, table

__all__ = ["binary_of", "blocks", "cut", "pack", "raw", "spread", "spread_join", "table", "unpack"]

#: Keys with more than this share of all rows are hot; so there are at most so many of them.
HOT_SHARE, LEAST_HOT = 1 / 1000, 500


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int):
    """Ranges [i, j) of documents of about ``size`` bytes together; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value."""
    head = np.array([len(arrays)] + [x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8)
    out, at = [], 8 * (2 * n + 1)
    for code, size in head.reshape(-1, 2):
        a = np.frombuffer(blob, np.dtype(chr(code)), size, at)
        out.append(a)
        at += a.nbytes
    return out


def binary_of(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", counted: str = "n") -> DataFrame:
    """``rows`` joined to ``keyed`` on ``key``, without a task that holds all rows of a hot key.

    ``keyed`` has one row a key, materialised, and ``counted``, the number of
    ``rows`` of it, which isn't returned. Hot keys, at most 1 / HOT_SHARE by
    their definition, are broadcast, and only the rows of all others shuffle.
    Null keys match nothing.
    """
    total = keyed.agg(F.sum(counted)).first()[0] or 0
    at_least = max(int(total * HOT_SHARE), LEAST_HOT)
    hot = keyed.filter(F.col(counted) > at_least)
    if not hot.limit(1).count():
        return rows.join(keyed.drop(counted), key, how)
    few = keyed.filter(F.col(counted) <= at_least).drop(counted)
    names = F.broadcast(hot.select(key))
    one = rows.join(F.broadcast(hot.drop(counted)), key)
    return one.unionByName(rows.join(names, key, "left_anti").join(few, key, how))

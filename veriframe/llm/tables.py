"""Small shared pieces: input tables, row keys, ragged numpy arrays, Arrow text buffers, packed payloads."""

from __future__ import annotations

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark):
    """The session's shuffle width: the number of parts that the cluster is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_with(value, name, make):
    """Something a worker makes of a broadcast value once, kept with it: it goes when the worker drops the broadcast."""
    if not hasattr(value, name):
        object.__setattr__(value, name, make())
    return getattr(value, name)


_LIBC = ctypes.CDLL(None)


def give_back(result=None):
    """``result``, after memory that this worker has freed went back to the system.

    Allocators keep what was freed, workers outlive their tasks, and an executor counts the workers of earlier stages as well.
    """
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)
    return result


def row_key(*columns):
    """128-bit key of a row's values; null and empty differ. Rows with equal values share it."""
    parts = [F.concat(F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(c.cast("string"), F.lit(""))) for c in columns]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def ragged(starts, lengths):
    """Flat index of the ranges ``[start, start + length)``, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def slices(sizes, limit):
    """Cut consecutive rows into runs of about ``limit`` in total; a larger row is a run of its own."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def text_buffer(column):
    """Bytes and row offsets of an Arrow string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary_column(data, offsets, kind=None):
    """Arrow binary (or string) column from one byte array and row offsets."""
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return column.cast(kind) if kind is not None else column


def pack(value, level=3):
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(payload):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def planes(numbers):
    """Non-negative numbers as byte planes, lowest first; the upper ones compress well."""
    numbers = np.asarray(numbers, np.int64)
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return [(numbers >> (8 * i)).astype(np.uint8) for i in range(width)]


def from_planes(parts):
    return sum(part.astype(np.int64) << (8 * i) for i, part in enumerate(parts))

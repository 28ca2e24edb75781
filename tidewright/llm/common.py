"""What the corpus operators share: byte packing, column guards, workers' memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, keep, scratch_root, tables_made  # noqa: F401
from ..session import ship

#: Bytes of text that one chunk of documents aims at.
CHUNK_BYTES = 8 << 20


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The named columns alone, so that further columns of the input cannot clash with ours."""
    return df.select(*[F.col(c) for c in cols])


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def pack(values: np.ndarray) -> bytes:
    """A numeric array as compressed bytes, byte planes apart, so that small or slowly growing values shrink."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(dtype).reshape(-1) if raw else np.empty(0, dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)).astype(np.uint64)) if len(values) else b""


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64) if data else np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def slices(sizes: np.ndarray, limit: int):
    """Ranges of consecutive rows whose sizes sum to about ``limit``; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def give_back() -> None:
    """Return what a worker has freed to the machine: workers live on from task to task, and two share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow by workers that can import this package."""
    ship(df.sparkSession)

    def all_batches(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(all_batches, schema)


def grouped(run: Callable) -> Callable:
    """A function of (key, table) or (key, table, table) for applyInArrow that gives its memory back."""
    if run.__code__.co_argcount == 2:

        def one(key, table):
            out = run(key, table)
            give_back()
            return out

        return one

    def two(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return two

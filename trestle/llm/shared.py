"""What the operators share: written tables, and text as byte arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from trestle.sources.tables import dropped, removed, shared_dir, written

#: Bytes of the batches that Spark hands to Python; its own default of 64 MB takes as much again on either side, for each core.
BATCH = 4 << 20

__all__ = ["bounded", "dropped", "lower_ascii", "mixed", "partitions", "removed", "shared_dir", "slices", "span_hashes", "utf8", "word_spans", "written"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame) -> DataFrame:
    """df, with batches of at most BATCH bytes from now on in its session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH}b")
    return df


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array, and n + 1 offsets. Null counts as empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have at most so many bytes, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
            yield b.slice(i, j - i)
            i = j
    given_back()


def given_back() -> None:
    """What this worker has freed or only kept for its next batch goes back to the system: it may wait for its next task for long, beside others that work."""
    _POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes other than 0x20 and 0x09 to 0x0D."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    s, e = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    first[s], last[e] = solid[s], solid[e]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.array([x + 32 * (65 <= x <= 90) for x in range(256)], np.uint8)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base, and of its inverse, from 0 to n; kept from one batch of a task to the next, up to 4 million of them."""
    found = _POWERS
    if len(found[0]) <= n:
        found = []
        for base in (_BASE, _BACK):
            out = np.full(max(n, 1 << 18) + 1, base)
            out[0] = 1
            found.append(np.cumprod(out))
        if n <= 4 << 20:
            _POWERS[:] = found
    return found[0][: n + 1], found[1][: n + 1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix sums of a polynomial in an odd base modulo 2**64."""
    n = len(data)
    power, back = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * power[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))

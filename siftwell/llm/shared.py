"""What the operators of this subpackage share: scratch tables, Arrow batches and word arrays.

Words are handled as byte ranges of a batch's UTF-8 text.  All separators used
here are ASCII, so cutting bytes and cutting code points give the same words.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step handles at once (a longer document forms a step of its own).
STEP_BYTES = 2 << 20
#: Bytes of Arrow data that Spark hands to a Python worker at once.
ARROW_BYTES = 8 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but ASCII white space.
PLAIN_WORDS = ~_SPACE
#: Words are runs of digits, letters and non-ASCII characters, after lower-casing A-Z.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder (``spark.checkpoint.dir``); only where none is set, a local one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch table and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # its shuffle files go when it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's shuffle width: the knob that scales every bucketed step with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_ready(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; after each task what it freed goes back, since workers stay, idle too, and count as the executor's memory."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return ran


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices batches so that each has about ``most`` bytes of text or one row; nulls in ``text`` become empty."""
    for batch in batches:
        k = batch.schema.get_field_index(text)
        col = batch.column(k)
        col = pc.fill_null(col.cast(pa.large_string()), "")
        batch = batch.set_column(k, pa.field(text, pa.large_string()), col)
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at, done = to, ends[to - 1]
    pa.default_memory_pool().release_unused()


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the n+1 offsets of its rows in them, from 0."""
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """The words of some texts: byte ``starts`` and ``ends`` in ``data``; row r has words ``first[r]`` to ``first[r + 1]``."""

    def __init__(self, col: pa.Array, kind: np.ndarray = PLAIN_WORDS, lower: bool = False):
        data, offs = text_bytes(col)
        if lower:
            data = LOWER[data]
        self.data, self.offs = data, offs
        self.inside = inside = kind[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        before = np.concatenate(([False], inside[:-1])) if len(data) else inside
        after = np.concatenate((inside[1:], [False])) if len(data) else inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def strings(self) -> pa.Array:
        """The words as an Arrow column."""
        to = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(to), pa.py_buffer(self.data[self.inside])])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes everywhere."""
        return range_hashes(self.data, self.starts, self.ends)


def ranges_to_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    to = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[at])])


_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_RANDOM = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number modulo 2^64, and those of its inverse."""
    if len(_powers[0]) < n:
        n = max(n + n // 16, (1 << 20) + 1024)
        for k, base in enumerate((int(_P), pow(int(_P), -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges from prefix sums, with a random value for each byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RANDOM[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive values; the result is shorter by n - 1."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out = out * _P + h[k : k + len(out)]
    return mix(out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges, one after another."""
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)


def covered(n: int, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Of n words, which lie in a range of ``size`` words from one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:n]) > 0

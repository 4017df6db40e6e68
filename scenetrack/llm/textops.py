"""Vectorised work on whole texts inside Arrow tasks: words, hashes of word runs, slices of bounded size.

Texts of a batch stay one UTF-8 byte buffer; words are its runs of bytes outside space, tab and line breaks.
A polynomial prefix sum modulo 2**64 gives the hash of any byte run or word run in constant time.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHUNK_BYTES = 1 << 19
U = np.uint64
BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]), 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """The texts of some rows as bytes with offsets; null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> Words:
        return Words(self)


class Words:
    """Words of all texts: byte start and end, first word of each text, hash of each word."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the total
        self.count = np.diff(self.first)
        up, _ = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
        self._byte_sums = sums
        self.hash = self.bytes_hash(self.start, self.end)
        up, _ = powers(len(self.hash) + 1)
        self._sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(self.hash * up[:-1], out=self._sums[1:])

    def bytes_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes start to end (exclusive), for each pair."""
        _, down = powers(len(self._byte_sums))
        return mix((self._byte_sums[end] - self._byte_sums[start]) * down[start] + (end - start).astype(U))

    def at(self, which: np.ndarray) -> Words:
        """Some of the words, without their texts."""
        out = copy.copy(self)
        out.start, out.end, out.hash = self.start[which], self.end[which], self.hash[which]
        return out

    def run_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start to end (exclusive), for each pair."""
        _, down = powers(len(self.hash) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U))

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each text's word sequence."""
        one = self.run_hash(self.first[:-1], self.first[1:])
        up, down = powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(mix(self.hash ^ U(0xD6E8FEB86659FD93)) * up[:-1], out=sums[1:])
        two = mix((sums[self.first[1:]] - sums[self.first[:-1]]) * down[self.first[:-1]] + self.count.astype(U))
        return one, two

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of size words, text by text, and offsets of each text; a shorter text is one run."""
        n = np.where(self.count == 0, 0, np.maximum(self.count - size + 1, 1))
        offsets = np.concatenate([[0], np.cumsum(n)])
        start = np.arange(offsets[-1]) + np.repeat(self.first[:-1] - offsets[:-1], n)
        end = np.minimum(start + size, np.repeat(self.first[1:], n))
        return self.run_hash(start, end), offsets


def column_texts(column: pa.Array) -> Texts:
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return Texts(raw[ends[0] : ends[-1]], ends - ends[0])


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Parts of a batch whose texts have limit bytes together at most, or one row."""
    whole = column_texts(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < len(whole):
        to = int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(whole))
        low, high = whole.offsets[at], whole.offsets[to]
        yield batch.slice(at, to - at), Texts(whole.data[low:high], whole.offsets[at : to + 1] - low)
        at = to


BATCH_BYTES, WIDE = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"  # the setting, and its default


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for sessions that use Spark's default size."""
    if spark.conf.get(BATCH_BYTES) == WIDE:
        spark.conf.set(BATCH_BYTES, str(CHUNK_BYTES * 8))


def map_texts(df: DataFrame, schema: str | StructType, work: Callable, text: str = "text") -> DataFrame:
    """Apply work(rows: RecordBatch, texts: Texts) -> dict of columns (or None) to bounded parts of df.

    Long texts make large Arrow batches, which tasks hold in the JVM and in Python; sessions that use Spark's default
    size get smaller ones.
    """
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text):
                out = work(rows, texts)
                if out is not None:
                    yield record_batch(out)

    return df.mapInArrow(run, schema)


def record_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([as_arrow(v) for v in columns.values()], names=list(columns))


def as_arrow(values) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    if isinstance(values, np.ndarray) and values.dtype == U:
        values = values.view(np.int64)
    if isinstance(values, np.ndarray) and values.ndim == 2:
        rows, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), as_arrow(values.reshape(-1)))
    return pa.array(values)

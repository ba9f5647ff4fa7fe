"""Helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.shared import map_array, write_array  # noqa: F401

#: Rows and bytes that an operator is given at once; a batch of one row may have more.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes of text that an operator holds at once; longer batches are worked on in parts.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes; nothing is copied."""
    for at in range(0, max(1, batch.num_rows), BATCH_ROWS):
        part = batch.slice(at, BATCH_ROWS)
        if part.nbytes <= BATCH_BYTES or part.num_rows < 2:
            yield part
            continue
        size = np.zeros(part.num_rows, dtype=np.int64)
        for column in part.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        for a, b in blocks(size.tolist(), BATCH_BYTES):
            yield part.slice(a, b - a)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded rows and bytes; Spark bounds what it sends at once by ``spark.sql.execution.arrow.maxBytesPerBatch``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(part for batch in batches for part in split(batch))

    return df.mapInArrow(work, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a column of strings."""
    return column.cast(pa.binary()).to_pylist()


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` at most, or that are one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets that occur in sorted rows, and the rows of each."""
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def code_points(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Offsets in bytes of UTF-8 as offsets in code points."""
    if data.isascii() or not len(offsets):
        return np.asarray(offsets, dtype=np.int64)
    begins = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(begins)))[np.asarray(offsets, dtype=np.int64)]


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a column's value as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor


def pack_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted uint64 keys as the first and the differences, of as few bytes as the largest needs, and their counts."""
    small = not len(counts) or int(counts.max()) < 256
    packed = b"\x00" * small + b"\x01" * (not small) + counts.astype("u1" if small else "<u8").tobytes()
    if not len(keys):
        return b"", packed
    gaps = np.diff(keys)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), packed


def unpack_sorted(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(counts, dtype="<u8" if counts[0] else "u1", offset=1).astype(np.int64)
    gaps = np.zeros((len(n), 8), dtype=np.uint8)
    if len(n):
        gaps[0] = np.frombuffer(keys, dtype=np.uint8, count=8, offset=1)
        gaps[1:, : keys[0]] = np.frombuffer(keys, dtype=np.uint8, offset=9).reshape(len(n) - 1, keys[0])
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64), n


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)

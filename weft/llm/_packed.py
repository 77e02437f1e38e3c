"""Packed rows: sorted columns of integers that a task sends to a bucket as one compressed row.

A shuffle of a billion small rows costs a row header, a hash and a comparison for each.  Here a task sorts
its numbers itself, cuts them into equal ranges (the buckets) and sends each range as byte planes of
differences.  The receiving task merges a bucket's few rows.  The number of buckets grows with the input,
so that a bucket has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "bucket int, kind int, batch long, data binary"
#: Buckets for each task that receives them, so that tasks get about as much.
EACH = 4
#: Bytes of packed rows that a task hands over at once.
SENT = 1 << 21


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of non-negative integers, each with its width in bytes, byte plane by byte plane, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for c, width in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns, as signed 64-bit numbers."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for width in widths:
        column = np.zeros((n, 8), np.uint8)
        column[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(column.view("<i8").ravel())
        at += n * width
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted column: small numbers; ``np.cumsum`` gives the column back."""
    return np.diff(x, prepend=x.dtype.type(0))


def ranges(ids: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """Sorted numbers below 2^bits by equal ranges: (range, its rows), but for empty ones.

    The 24 leading bits decide, so that there can be 2^24 buckets.
    """
    if not len(ids):
        return
    shift = ids.dtype.type(bits - 24)
    each = ((ids >> shift).astype(np.int64) * buckets) >> 24
    starts = np.flatnonzero(np.diff(each, prepend=-1))
    for i, j in zip(starts, np.append(starts[1:], len(ids)), strict=True):
        yield int(each[i]), slice(int(i), int(j))


def rows(found: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """(bucket, kind, batch, data) rows, in batches of about ``SENT`` bytes."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    begin = size = 0
    for i, row in enumerate(found, 1):
        size += len(row[3])
        if size >= SENT or i == len(found):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found[begin:i]], kind) for k, kind in enumerate(kinds)], ["bucket", "kind", "batch", "data"])
            begin, size = i, 0


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, int, bytes]]]]:
    """Rows sorted by bucket: each bucket with its (kind, batch, data)."""
    bucket, held = None, []
    for batch in batches:
        for at, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != bucket and held:
                yield bucket, held
                held = []
            bucket = at
            held.append(tuple(row))
    if held:
        yield bucket, held


def dealt(packed: DataFrame, buckets: int, *order: str, each: int = EACH) -> DataFrame:
    """Packed rows by bucket, about ``each`` buckets to a task, sorted within it."""
    return packed.repartition(max(1, buckets // each), "bucket").sortWithinPartitions("bucket", *order)

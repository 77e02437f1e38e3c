"""Word normalisation and hashing shared by the text operators.

Words are runs of letters and digits: ASCII characters other than ``0-9A-Za-z`` separate them, every
other character belongs to a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")
#: Maps a byte to itself or, for an ASCII separator, to a space.
SPACED = bytes(b if b >= 0x80 or b in _KEPT else 0x20 for b in range(256))
#: The same, and lower-cases A-Z.
ASCII_LOWERED = bytes(SPACED[b + 32] if 65 <= b <= 90 else SPACED[b] for b in range(256))

U64 = np.uint64
MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Texts are worked on in pieces of about this many bytes, so that temporary arrays stay small.
PIECE = 1 << 20
#: A worker's word cache is emptied beyond this many entries.
CACHE = 100_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text (null: none)."""
    return (text or "").lower().encode("utf-8", "replace").translate(SPACED).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, near inputs spread."""
    x = (x ^ (x >> U64(32))) * MIX_A
    x = (x ^ (x >> U64(29))) * MIX_B
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """word -> 64-bit hash, the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pieces(texts: Iterable[str | None], limit: int = PIECE) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in runs of about ``limit`` characters; null texts become empty."""
    run: list[str] = []
    first = size = 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and size + len(text) > limit:
            yield first, run
            run, first, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield first, run


def text_pieces(texts: pa.Array, rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """``pieces`` of an Arrow column, of which only some rows at a time become Python strings."""
    for at in range(0, len(texts), rows):
        for first, some in pieces(texts.slice(at, rows).to_pylist()):
            yield at + first, some


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system when it ends: workers outlive their tasks."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def list_array(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from numpy rows."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))

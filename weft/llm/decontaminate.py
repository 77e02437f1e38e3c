"""Benchmark decontamination by the q-gram lemma.

A benchmark item of m characters (normalised: lower-case words joined by single spaces) occurs in a
text with at most k edits only if item and text share at least ``m + 1 - q (k + 1)`` q-grams whose
diagonals (place in the text minus place in the item) differ by k at most.  q-gram hits are counted in
overlapping diagonal bands of width 2 (k + 1), one starting every k + 1 diagonals, so that one band
holds them all; runs of bands that meet the bound are verified by an alignment that is banded to the
diagonals in question.  ``k = ERRORS * m``, fewer where an item is so short that the bound would be less
than 1; an item shorter than q must occur exactly, as whole words.

q-grams that many items share (a common opening, say) are left out of the index, the commonest first: an
item that leaves r of its q-grams out must share r fewer, so nothing is lost while the bound stays at 1 or
more.  Equal items are one item of the index.

The benchmark is worked on in blocks of ``BLOCK`` characters, one after the other, each one narrow pass
over the documents with an index of bounded size; a benchmark of usual size is one block.  No shuffle of
documents.

Edge cases: null and empty texts, and texts without a word, match nothing; items without a word match
nothing; equal items all match; repeated rows match each; texts are scanned whole; with an empty
benchmark or no documents there are no matches; rows with a null doc_id are scanned and reported with
it.  Other columns are ignored by ``matches`` and kept untouched by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import drop, stored
from weft.llm._text import MIX_A, U64, words_of

Q = 12
ERRORS = 0.05
#: Items beyond which a q-gram is common.
COMMON = 8
#: Characters of benchmark in one index, and bits of its prefilter's table.
BLOCK = 4_000_000
BITS = 24
#: Characters of documents that are searched at once, and hits that are counted at once.
SEARCHED = 1 << 20
HITS = 1 << 22
#: Bands of a run that one alignment takes.
RUN = 3


def normal(text: str | None) -> bytes:
    return b" ".join(words_of(text))


def gram_hashes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q bytes from each place (uint8 array), as many as there are whole q-grams."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(text) - 7, "<u8", np.ascontiguousarray(text), strides=(1,))
    four = np.ndarray(len(text) - 3, "<u4", np.ascontiguousarray(text), strides=(1,))
    out = eight[:n] * MIX_A
    out ^= out >> U64(32)
    out += four[q - 4 : q - 4 + n]
    out *= MIX_A
    out ^= out >> U64(29)
    return out


def left_out(gram: np.ndarray, item: np.ndarray, bound: np.ndarray, common: int = COMMON) -> np.ndarray:
    """Which postings to leave out: those of common grams, the commonest of an item first, while its bound stays at 1."""
    if not len(gram):
        return np.zeros(0, bool)
    _, at = np.unique(gram, return_inverse=True)
    owners = np.bincount(np.unique(np.stack([at, item]), axis=1)[0])[at]  # items that have the gram
    order = np.lexsort((-owners, item))
    place = np.empty(len(gram), np.int64)  # of a posting among its item's, the commonest first
    firsts = np.searchsorted(item[order], np.arange(len(bound)))
    place[order] = np.arange(len(gram)) - firsts[item[order]]
    return (owners > common) & (place < bound[item] - 1)


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list[list[int]]  # of each distinct item
    items: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # first posting of each, and one more
    item: np.ndarray  # postings: the item and the place in it
    place: np.ndarray
    table: np.ndarray  # whether any gram has these leading bits
    short: ahocorasick.Automaton | None  # items below q characters, between spaces

    @classmethod
    def of(cls, ids: list[int], items: list[bytes], q: int = Q, errors: float = ERRORS) -> Index:
        of_item: dict[bytes, list[int]] = {}
        for i, x in zip(ids, items, strict=True):
            of_item.setdefault(x, []).append(i)
        items = list(of_item)
        length = np.array([len(x) for x in items], np.int64)
        edits = np.minimum((errors * length).astype(np.int64), np.maximum((length - q) // q, 0))
        bound = length + 1 - q * (edits + 1)
        hashes = [gram_hashes(np.frombuffer(x, np.uint8), q) for x in items]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)]).astype(np.int64)
        out = left_out(every, item, bound)
        bound = bound - np.bincount(item[out], minlength=len(items))
        every, item, place = every[~out], item[~out], place[~out]
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        table = np.zeros(1 << BITS, bool)
        table[(every >> U64(64 - BITS)).astype(np.int64)] = True
        short = ahocorasick.Automaton()
        for i, x in enumerate(items):
            if 0 < len(x) < q:
                short.add_word(f" {x.decode('latin-1')} ", (i, len(x)))
        short.make_automaton()
        return cls(list(of_item.values()), items, edits, bound, grams, np.append(first, len(every)), item[order], place[order], table, short if len(short) else None)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the verified regions, best first where regions overlap."""
        found = []
        joined = b"\n".join(texts)  # no q-gram of an item holds a newline
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        for i, low, width in self._bands(joined):
            k, half = int(self.edits[i]), len(self.items[i]) // 2
            middle = low + width // 2
            for t in {int(np.searchsorted(starts, max(x, 0), side="right")) - 1 for x in (low + k, middle, middle + half)}:
                if 0 <= t < len(texts):
                    hit = aligned(self.items[i], texts[t], low - int(starts[t]), width, k)
                    if hit:
                        found.append((t, i, *hit))
        if self.short is not None:
            for t, text in enumerate(texts):
                for end, (i, n) in self.short.iter(f" {text.decode('latin-1')} "):
                    found.append((t, i, end - n - 1, end - 1, 0))
        return _separate(found)

    def _bands(self, joined: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, least diagonal, diagonals) of the runs of bands that meet the bound."""
        hashes = gram_hashes(np.frombuffer(joined, np.uint8))
        at = np.flatnonzero(self.table[(hashes >> U64(64 - BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        which = np.searchsorted(self.grams, hashes[at])
        which[which == len(self.grams)] = 0
        true = self.grams[which] == hashes[at]
        at, which = at[true], which[true]
        n = self.first[which + 1] - self.first[which]
        upto, floor = np.cumsum(n), len(joined) + 1
        keys, counts = [], []
        begin = 0
        while begin < len(at):  # so many hits at once that their postings stay bounded
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, side="right")))
            m = n[begin:end]
            posting = np.repeat(self.first[which[begin:end]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            item, diagonal = self.item[posting], np.repeat(at[begin:end], m) - self.place[posting]
            band = (diagonal + floor) // (self.edits[item] + 1)  # a band takes two of these steps: this one and the one before
            key, count = np.unique(np.concatenate([item * (4 * floor) + band, item * (4 * floor) + band - 1]), return_counts=True)
            keys.append(key)
            counts.append(count)
            begin = end
        if not keys:
            return
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(place, np.concatenate(counts))
        met = key[count >= self.bound[key // (4 * floor)]]
        if not len(met):
            return
        breaks = np.flatnonzero(np.diff(met, prepend=met[0] - 2) != 1)
        for i, j in zip(breaks, np.append(breaks[1:], len(met)), strict=True):
            for first in range(i, j, RUN):
                item, step = divmod(int(met[first]), 4 * floor)
                wide = int(self.edits[item]) + 1
                yield item, step * wide - floor, (min(first + RUN, j) - first + 1) * wide


def aligned(item: bytes, text: bytes, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence with at most k edits that starts on a diagonal in
    [low, low + width) and strays at most k from there; None if there is none."""
    m = len(item)
    begin, end = max(low, 0), min(low + width + m + k, len(text))
    exact = text.find(item, begin, end)
    if exact >= 0:
        return exact, exact + m, 0
    if not k:
        return None
    # D[c]: fewest edits of the item's first i characters against text ending at column i + low - k + c
    cols, source = width + 2 * k, np.frombuffer(text, np.uint8)
    padded = np.zeros(m + cols + 1, np.uint8)
    left = low - k
    a, b = max(left, 0), min(left + len(padded), len(text))
    if a < b:
        padded[a - left : b - left] = source[a:b]
    inside = np.zeros(len(padded) + 1, bool)  # places between characters that lie in the text
    inside[max(0, -left) : max(0, len(text) - left) + 1] = True
    far = 4 * k + m
    ramp = np.arange(cols)
    cost = np.where(inside[:cols], 0, far)
    origin = np.arange(cols)
    for i in range(m):
        sub = cost + (padded[i : i + cols] != item[i])
        skip = np.append(cost[1:], far) + 1
        best = np.minimum(sub, skip)
        source_of = np.where(sub <= skip, origin, np.append(origin[1:], cols))
        best = np.where(inside[i + 1 : i + 1 + cols], best, far)
        chain = np.minimum.accumulate(best - ramp)  # insertions run along a row
        cost = chain + ramp
        holder = np.maximum.accumulate(np.where(best - ramp == chain, ramp, 0))
        origin = source_of[holder]
        if cost.min() > k:
            return None
    c = int(cost.argmin())
    start, stop = left + int(origin[c]), left + m + c
    return (max(start, 0), min(stop, len(text)), int(cost[c])) if cost[c] <= k else None


def _separate(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of overlapping regions of one item in one text, the one of fewest edits, the first of equals."""
    kept: list[tuple[int, int, int, int, int]] = []
    for hit in sorted(set(found), key=lambda h: (h[0], h[1], h[2], h[4], h[3])):
        if kept and kept[-1][:2] == hit[:2] and hit[2] < kept[-1][3]:
            if hit[4] < kept[-1][4]:
                kept[-1] = hit
        else:
            kept.append(hit)
    return kept


SCHEMA = "doc_id long, item_id long, start long, stop long, first_word long, edits long, passage string"


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, normalised texts) in runs of about ``SEARCHED`` characters."""
    run: list[bytes] = []
    begin = size = 0
    for j, text in enumerate(texts):
        if run and size + len(text or "") > SEARCHED:
            yield begin, run
            run, begin, size = [], j, 0
        run.append(normal(text))
        size += len(run[-1])
    if run:
        yield begin, run


def _finder(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for begin, texts in _runs(batch.column(1).to_pylist()):
                for t, i, start, stop, edits in index.value.search(texts):
                    where = (start, stop, texts[t].count(b" ", 0, start), edits, texts[t][start:stop].decode("utf-8", "replace"))
                    rows += [(ids[begin + t], one, *where) for one in index.value.ids[i]]
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def _leaking(index, text: str) -> Column:
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for begin, run in _runs(texts.to_pylist()):
            for t, *_ in index.value.search(run):
                out[begin + t] = True
        return pa.array(out)

    return leaks(F.col(text))


def _blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The benchmark's items in runs of about ``block`` characters; at most that much is held at once."""
    ids: list[int] = []
    items: list[bytes] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        item = normal(row[1])
        if not item:
            continue
        if ids and size + len(item) > block:
            yield ids, items
            ids, items, size = [], [], 0
        ids.append(row[0])
        items.append(item)
        size += len(item)
    if ids:
        yield ids, items


def _indexes(benchmark: DataFrame, block: int) -> Iterator[tuple[object, bool]]:
    """Each block's broadcast index, and whether another follows; it is dropped before the next is built."""
    left = _blocks(benchmark, block)
    now = next(left, None)
    while now is not None:
        then = next(left, None)
        index = benchmark.sparkSession.sparkContext.broadcast(Index.of(*now))
        yield index, then is not None
        if then is not None:
            index.destroy()
        now = then


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per region of a document that holds a benchmark item within its edit budget.

    ``start`` and ``stop`` are byte places in the normalised text, ``first_word`` the number of the word
    there.  The last block's matches are not computed before they are asked for; earlier ones are stored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for n, (index, more) in enumerate(_indexes(benchmark, block)):
        part = rows.mapInArrow(_finder(index), SCHEMA)
        part = stored(part, "matches") if more else part
        out = out.unionAll(part) if n else part
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; order and other columns as they are."""
    kept = docs
    for n, (index, more) in enumerate(_indexes(benchmark, block)):
        clean = kept.filter(~_leaking(index, text))
        if more:
            clean = stored(clean, "clean")
            if n:
                drop(kept)
        kept = clean
    return kept

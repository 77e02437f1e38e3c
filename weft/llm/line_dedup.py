"""Fuzzy line dedup by MinHash.

A line is compared by the character shingles (``SHINGLE`` bytes) of its normalised form: lower-case
words joined by single spaces.  Signatures are one-permutation MinHash over BANDS * ROWS bins, empty
bins filled from the next full one; lines that agree in one band are candidates, candidates are verified
by the exact Jaccard similarity of their shingle sets (``THRESHOLD``), and distributed union-find
turns links into components.  The first line of each component, by (doc_id, line number), is kept.

With 5 rows and 14 bands a pair at the threshold is a candidate with probability 0.996, at 0.9 with 1.

Edge cases: lines without a word (blank ones too) take no part and are kept; a null text has no line
and stays null; a line shorter than a shingle is one shingle; equal normalised lines are copies of
each other; lines of rows with a null doc_id take no part and are kept; rows repeated with one doc_id
count their lines once; a text whose lines all go becomes empty; empty tables give empty results; other
columns, whatever their names, are kept untouched.  Lines are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import candidates
from weft.llm._scratch import drop, stored, unused
from weft.llm._text import MIX_A, MIX_B, PIECE, SPACED, U64, as_signed, lean, list_array, mix, text_pieces

SHINGLE = 8
BANDS, ROWS = 14, 5
BINS = BANDS * ROWS
THRESHOLD = 0.8


def normal_lines(text: str) -> list[bytes]:
    """The normalised lines of a text; empty where a line has no word."""
    return [b" ".join(x.split()) for x in text.lower().encode("utf-8", "replace").translate(_SPACED_BUT_NEWLINE).split(b"\n")]


_SPACED_BUT_NEWLINE = SPACED[:10] + b"\n" + SPACED[11:]


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def shingles(line: bytes) -> np.ndarray:
    """Distinct shingles of a normalised line, sorted."""
    if len(line) < SHINGLE:
        line = line.ljust(SHINGLE, b"\0")
    found = np.sort(np.ndarray(len(line) - SHINGLE + 1, "<u8", line, strides=(1,)))
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def band_keys(lines: list[bytes]) -> np.ndarray:
    """[lines, BANDS] bucket keys."""
    padded = [x.ljust(SHINGLE, b"\0") for x in lines]
    lengths = np.array([len(x) for x in padded])
    buffer = b"".join(padded)
    grams = np.ndarray(len(buffer) - SHINGLE + 1, "<u8", buffer, strides=(1,))
    grams = grams * MIX_A
    grams ^= grams >> U64(29)
    grams *= MIX_B
    owner = np.repeat(np.arange(len(lines), dtype=np.int64), lengths)
    inside = np.ones(len(buffer), bool)  # not across the end of a line
    ends = np.cumsum(lengths)
    for back in range(1, SHINGLE):
        inside[ends - back] = False
    inside = inside[: len(grams)]
    grams, owner = grams[inside], owner[: len(inside)][inside]
    bins = ((grams >> U64(32)) * U64(BINS) >> U64(32)).astype(np.int64)
    full = np.uint32(0xFFFFFFFF)
    signature = np.full(len(lines) * BINS, full, np.uint32)
    np.minimum.at(signature, owner * BINS + bins, (grams & U64(0xFFFFFFFF)).astype(np.uint32))
    signature = signature.reshape(len(lines), BINS)
    empty = signature == full
    step = 1
    while step < BINS and empty.any():  # from the next full bin, in doubling steps
        filled = np.roll(signature, -step, axis=1)
        signature = np.where(empty, filled, signature)
        empty &= np.roll(empty, -step, axis=1)
        step *= 2
    rows = signature.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(lines), BANDS))
    for i in range(ROWS):
        key = mix(key * MIX_A + rows[:, :, i])
    return key


@lean
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line number, line hash, line) of every line that has a word; the line itself once in a batch."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        seen: set[int] = set()
        for first, texts in text_pieces(batch.column(1)):
            docs, numbers, hashes, lines = [], [], [], []
            for i, text in enumerate(texts, first):
                for n, line in enumerate(normal_lines(text)):
                    if line:
                        docs.append(ids[i])
                        numbers.append(n)
                        hashes.append(h := line_hash(line))
                        lines.append(None if h in seen else line)
                        seen.add(h)
            at = as_signed(np.array(hashes, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(at), pa.array(lines, pa.binary())], ["doc_id", "line_no", "id", "line"])


def _keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(band key, line hash) of lines."""
    hashes, lines = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    begin = size = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or size > PIECE:
            if i > begin:
                yield as_signed(band_keys(lines[begin:i])).ravel(), np.repeat(hashes[begin:i], BANDS)
            begin, size = i, 0
        if i < len(lines):
            size += len(lines[i])


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(x) + len(y) - common)


def _verify(least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, la, lb = (c.to_pylist() for c in batch.columns)
            held: dict[bytes, np.ndarray] = {}
            kept = []
            for i, (x, y) in enumerate(zip(la, lb, strict=True)):
                if len(held) > 1000:
                    held.clear()
                p, q = (held[t] if t in held else held.setdefault(t, shingles(t)) for t in (x, y))
                if min(len(p), len(q)) >= least * max(len(p), len(q)) and jaccard(p, q) >= least:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in kept], pa.int64()) for v in (a, b)], ["a", "b"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line hash, distinct shingles) of lines."""
    for batch in batches:
        held = [as_signed(shingles(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(held, pa.int64())], ["id", "elements"])


def _line_table(docs: DataFrame, text: str) -> DataFrame:
    """``_lines`` of the documents, read once and stored: all later steps read from it what they need."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(text))
    return stored(rows.mapInArrow(_lines, "doc_id long, line_no int, id long, line binary"), "lines")


def _links(lines: DataFrame, least: float, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    whole = lines.filter("line is not null").select("id", "line")
    rows = candidates.buckets(whole, _keys, BANDS)
    pairs = candidates.paired(rows)
    wanted = rows.select("id").distinct()
    texts = stored(whole.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("line").alias(f"l{x}")).hint("merge")  # noqa: E731  pairs and lines both grow with the corpus
    sides = lambda some: some.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb")
    verify = lambda some: stored(sides(some).mapInArrow(_verify(least), "a long, b long"), "links")
    sets = lambda ids: texts.join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, elements array<long>")
    bodies = lambda ids: texts.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("line").alias("body"))
    joined = lambda some: candidates.within(some, bodies(some.select("id").distinct()), least, lambda lines: [shingles(x) for x in lines.to_pylist()])
    verified, roots = candidates.settle(rows, pairs, verify, sets, least, exact, joined)
    for done in (pairs, texts, rows):
        drop(done)
    return verified, roots


def line_links(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """Verified ``(a, b)``, hashes of distinct lines whose shingles' Jaccard similarity is ``least`` or more, and their components.

    The links join all lines that belong together; they are not all similar pairs of a large group.
    """
    lines = _line_table(docs, text)
    out = _links(lines, least, exact)
    drop(lines)
    return out


def line_classes(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """One row per line that has a word: its place, the place that stays of its class, and ``keep``."""
    lines = _line_table(docs, text)
    links, roots = _links(lines, least, exact)
    drop(links)
    of = lines.select("doc_id", "line_no", "id").join(roots.hint("merge"), "id", "left").select("doc_id", "line_no", F.coalesce("root", "id").alias("class"))
    of = stored(of, "places")
    drop(lines)
    drop(roots)
    heads = of.groupBy("class").agg(F.min(F.struct("doc_id", "line_no")).alias("head"), F.count("*").alias("n")).filter("n > 1")
    heads = stored(heads.select("class", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no")), "heads")
    out = of.join(heads.hint("merge"), "class", "left")  # both sides dealt for the join alone, so that a hot class can be split
    out = out.select("doc_id", "line_no", F.coalesce("class_doc_id", "doc_id").alias("class_doc_id"), F.coalesce("class_line_no", "line_no").alias("class_line_no"))
    return out.withColumn("keep", (F.col("class_doc_id") == F.col("doc_id")) & (F.col("class_line_no") == F.col("line_no")))


def deduplicate_lines(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """``docs`` with the lines removed that are not the first of their class; every row stays."""
    gone = line_classes(docs, text, least, exact).filter("not keep").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for value, drops in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            if value is not None and drops:
                out_of = set(drops)
                value = "\n".join(line for n, line in enumerate(value.split("\n")) if n not in out_of)
            out.append(value)
        return pa.array(out, pa.string())

    key, mark = unused(docs, "id", "gone")
    gone = gone.select(F.col("doc_id").alias(key), F.col("gone").alias(mark))
    joined = docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left")
    return joined.withColumn(text, without(F.col(text), F.col(mark))).select(*docs.columns)

"""Near-duplicate documents by Order MinHash.

The words' runs of ``K`` (word k-mers), each labelled with its occurrence number, are hashed by ``M``
functions.  Of each function, the ``L`` smallest labelled k-mers are kept in text order; documents that
agree in one such tuple are candidates.  Candidates are verified by an alignment of their k-mers inside
a band as wide as the edits that the threshold allows: the similarity is the number of aligned equal
k-mers over the number of k-mers of either text.  That is at most the Jaccard similarity of the k-mer
multisets, and sensitive to order.  An alignment's memory is linear in the texts.

Exact copies (equal words) share a class without any candidate: only one document of each distinct
text is sketched, paired and verified.  Classes are the connected components of the verified links.

Edge cases: null and empty texts, and texts without a word, have equal (no) words and so share one
class; a text of fewer than K words is one k-mer; rows with a null doc_id take no part and are absent
from the result; rows repeated with the same doc_id and text count once; of a doc_id with several
texts, the one of the smallest digest counts; ties go to the smallest doc_id; empty
tables give empty results; other columns are ignored.
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
from weft.llm._text import MIX_A, U64, WordHashes, as_signed, lean, list_array, mix, text_pieces, words_of

K, L, M = 5, 3, 16
THRESHOLD = 0.8

_SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64) * MIX_A)[:, None]
_HASHES = WordHashes()


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """One hash of each run of k words; of all words if there are fewer."""
    n = max(len(hashes) - k + 1, min(len(hashes), 1))
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(hashes))):
        out = out * MIX_A + hashes[i : i + n]
    return mix(out)


def sketch(grams: np.ndarray) -> np.ndarray:
    """M bucket keys of a text's k-mers: the L smallest labelled k-mers of each function, in text order."""
    if not len(grams):
        return np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(len(grams))
    nth = np.empty(len(grams), np.uint64)  # occurrence numbers
    nth[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    labelled = mix(grams + nth * MIX_A)  # in every text alike: a k-mer's rank must not depend on other repeats
    ranks = (labelled[None, :] ^ _SEEDS) * (_SEEDS | U64(1))
    ranks ^= ranks >> U64(31)
    ranks *= MIX_A
    took = min(L, len(grams))
    least = np.sort(np.argpartition(ranks, took - 1, axis=1)[:, :took], axis=1) if len(grams) > took else np.broadcast_to(np.arange(took), (M, took))
    key = _SEEDS[:, 0]
    for i in range(took):
        key = mix(key * MIX_A + grams[least[:, i]])
    return key


@lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, keys, ids = [], [], batch.column(0).to_pylist()
        for _, texts in text_pieces(batch.column(1)):
            for text in texts:
                words = words_of(text)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                keys.append(as_signed(sketch(kmers(_HASHES.of(words)))))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), list_array(keys, pa.int64())], ["id", "same", "keys"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), batch.column(1)], ["id", "same", "text"])


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        odd = np.flatnonzero(a[at : at + step][: n - at] != b[at : at + step][: n - at])
        if len(odd):
            return at + int(odd[0])
        at += step
        step *= 4
    return n


def shared_grams(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """Size of the intersection of two k-mer multisets, and Jaccard similarity of the sets: bounds of any alignment's."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()), len(both) / (len(x) + len(y) - len(both))


def longest_common(a: np.ndarray, b: np.ndarray, need: float) -> int:
    """Length of the longest common subsequence of two sequences if it is ``need`` or more, else any number below.

    The alignment is banded: in one that leaves at most max(len) - need elements of a side out, partners are
    at most as many places apart.  A column of the table is one integer whose bits tell where the length
    grows, so that memory is linear in the texts and a row costs one addition.
    """
    start = _run(a, b)
    a, b = a[start:], b[start:]
    stop = _run(a[::-1], b[::-1])
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    ends, need = start + stop, need - start - stop
    if min(len(a), len(b)) < need or not len(a):
        return ends
    width = int(max(len(a), len(b)) - max(need, 0))
    places: dict[int, list[int]] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    often = max(16, len(a) // 1024)  # elements of more places have a mask each: at most 1024 of them
    masks = {x: sum(1 << i for i in at) for x, at in places.items() if len(at) > often}
    full = (1 << len(a)) - 1
    column, n = full, len(b)
    for j, x in enumerate(b.tolist()):
        low, high = j - width, j + width
        if x in masks:
            hits = masks[x] >> max(low, 0) << max(low, 0)
            if high + 1 < len(a):
                hits &= (1 << (high + 1)) - 1
        else:
            hits = 0
            for i in places[x]:
                if low <= i <= high:
                    hits |= 1 << i
        both = column & hits
        column = ((column + both) | (column - both)) & full
        if j & 255 == 255 and len(a) - column.bit_count() + n - j - 1 < need:
            break
    return ends + len(a) - column.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, k: int = K, least: float = THRESHOLD) -> float:
    """Aligned k-mer similarity of two texts' word hashes; 0 where it is below ``least``.

    The texts' k-mers are aligned in order: the similarity is the number of aligned equal k-mers over the
    number of k-mers of either text, and at most the Jaccard similarity of the sets.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    ga, gb = kmers(a, k), kmers(b, k)
    grams = len(ga) + len(gb)
    need = least * grams / (1 + least)  # common k-mers at which common / (grams - common) = least
    common, sets = shared_grams(ga, gb)
    if common < need - 1e-9 or sets < least:
        return 0.0
    common = longest_common(ga, gb, need - 1e-9)
    found = min(common / (grams - common), sets)
    return found if found >= least else 0.0


def _verify(least: float):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 64):
                held: dict[str, np.ndarray] = {}
                for a, b, ta, tb in zip(*(c.slice(at, 64).to_pylist() for c in batch.columns), strict=True):
                    p, q = (held[t] if t in held else held.setdefault(t, _HASHES.of(words_of(t))) for t in (ta, tb))
                    found = similarity(p, q, least=least)
                    if found >= least:
                        out.append((a, b, found))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, distinct k-mers) of texts; a text without words has one that no other has."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(_grams_of(batch.column(1)), pa.int64())], ["id", "elements"])


def _grams_of(texts: pa.Array) -> list[np.ndarray]:
    """The distinct k-mers of texts."""
    held = [as_signed(np.unique(kmers(_HASHES.of(words_of(t))))) for t in texts.to_pylist()]
    return [x if len(x) else np.zeros(1, np.int64) for x in held]


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket key, id) of sketches."""
    lists = batch.column(1)
    yield lists.flatten().to_numpy(zero_copy_only=False), np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))


def links(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, first document with the same words), verified links between first documents, and their components.

    The links join all documents that belong together; they are not all similar pairs of a large group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null")
    each = rows.mapInArrow(_sketches, "id long, same binary, keys array<long>")
    sketched = stored(each.groupBy("id").agg(F.min_by("keys", "same").alias("keys"), F.min("same").alias("same")), "sketches")
    several = sketched.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = stored(several.select("same", "first"), "firsts")  # stored: both sides are dealt for the join alone, so that a hot text can be split
    copies = stored(sketched.select("id", "same").join(firsts.hint("merge"), "same", "left").select("id", F.coalesce("first", "id").alias("first"), "same"), "copies")
    distinct = sketched.join(copies.filter("id = first").select("id").hint("merge"), "id", "left_semi")
    rows_of = candidates.buckets(distinct.select("id", "keys"), _keyed, M)
    pairs = candidates.paired(rows_of)
    for done in (sketched, firsts):
        drop(done)
    wanted = stored(rows_of.select("id").distinct().join(copies.select("id", "same").hint("merge"), "id"), "wanted")
    found = rows.join(wanted.select("id").hint("merge"), "id", "left_semi").mapInArrow(_digests, "id long, same binary, text string")
    texts = stored(found.join(wanted.hint("merge"), ["id", "same"], "left_semi").dropDuplicates(["id"]), "texts")
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}")).hint("merge")  # noqa: E731  pairs and texts both grow with the corpus
    sides = lambda some: some.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    verify = lambda some: stored(sides(some).mapInArrow(_verify(least), "a long, b long, similarity double"), "links")
    sets = lambda ids: texts.select("id", "text").join(ids.hint("merge"), "id", "left_semi").mapInArrow(_sets, "id long, elements array<long>")
    bodies = lambda ids: texts.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("text").alias("body"))
    alike = lambda x, y: similarity(_HASHES.of(words_of(x)), _HASHES.of(words_of(y)), least=least) >= least
    joined = lambda some: candidates.within(some, bodies(some.select("id").distinct()), least, _grams_of, alike)
    verified, roots = candidates.settle(rows_of, pairs, verify, sets, least, exact, joined)
    for done in (pairs, texts, wanted, rows_of):
        drop(done)
    return copies.select("id", "first"), verified, roots


def classes(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """One row per doc_id: ``doc_id, class_id``, the smallest doc_id of the class."""
    copies, verified, roots = links(docs, text, least, exact)
    drop(verified)
    of = copies.join(roots.withColumnRenamed("id", "first").hint("merge"), "first", "left")
    return of.select(F.col("id").alias("doc_id"), F.coalesce("root", "first").alias("class_id"))


def deduplicate(docs: DataFrame, text: str = "text", least: float = THRESHOLD, exact: bool = True) -> DataFrame:
    """``docs`` without the documents that are not the first of their class; rows without an id stay."""
    (key,) = unused(docs, "id")
    gone = classes(docs, text, least, exact).filter("doc_id != class_id").select(F.col("doc_id").alias(key))
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left_anti")

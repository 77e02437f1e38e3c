"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated word-bigram models, one of the toxic and one of the ordinary training texts.  A text is
its words between two boundaries.  Of class c, with D the discount, n counts, T(v) the number of distinct
words after v, and V the number of distinct words:

    P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + D T_c(v) / n_c(v) P_c(w)
    P_c(w)     = max(n_c(w) - D, 0) / N_c + D V_c / N_c shared(w)

``shared`` is the continuation distribution pooled over both classes, so that a word or pair that is rare
in one class gets the same estimate in both.  Words that the training texts show once, and unknown ones,
share one estimate a class, that of all such words.  A text is judged by length-normalised log-likelihood
ratios, turned into a probability by logistic regression on rows that the counts have not seen: over the
whole text at both orders, and over its most toxic window and its strongest words at the lower order, where
the smaller class does not pay for the word pairs that it never showed.

All counts are exact and grow with the corpus: every labelled row outside the held-out fold is counted but
for the calibration sample (``CALIBRATION_ROWS``, the only bounded sample).  Pairs are counted and kept in
hash buckets, about one for each ``BUCKET`` characters of text, and texts are scored by sending their
pairs to those buckets, packed (``_packed``); sums for each text come back.  No task holds more than a
bucket, no pair table is broadcast.  The word table is broadcast up to ``WORDS`` words; beyond, texts are
scored by joins with the same result.  Words are told apart by 40 bits of a hash.

Edge cases: a null text counts as empty; an empty text's ratios are 0; with no training row of either
class every score is the share of toxic rows (0 if there are no labels).  A document with several label
rows counts as toxic if any says so.  Repeated documents are scored each, equal texts equally.  A null
doc_id is never a training row.  Empty tables give empty results.  Columns other than those named in the
call are kept untouched; added columns replace columns of the same names.  ``docs`` is to be read from
files (as ``stored`` tables are): a task that is repeated must see its rows in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import _packed
from weft.llm._scratch import drop, released, stored, unused
from weft.llm._text import CACHE, MIX_A, MIX_B, U64, WordHashes, lean, mix, text_pieces, words_of

WORD_BITS, PAIR_BITS = 40, 48  # of the numbers of words, and of pairs while they are counted
DISCOUNT = 0.75
WINDOW = 4
#: Log-likelihood ratio of a word beyond which it counts as evidence of its own.
EVIDENT = 2.0
FEATURES = ("pairs", "words", "window", "excess", "length")
#: Characters of text for each bucket of pairs, and the least number of buckets.
BUCKET, BUCKETS = 4_000_000, 32
#: Words that a task holds before it passes its counts on, words before it passes its texts' pairs on, and texts
#: (a text's number takes two bytes, beside the pair's at most 48 bits).
COUNTED, FLUSH, TEXTS = 500_000, 2_000_000, 60_000
#: Words up to which the word table is broadcast (about 32 bytes each).
WORDS = 4_000_000
#: Steps of a pair's gain in one unit.
GRAIN = 2048
#: Label rows up to which they are broadcast; beyond, documents and labels are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
CALIBRATION_ROWS = 20_000
#: Of the five folds of crc32(doc_id): 0 is held out, the calibration sample is of fold 4.
FOLDS, HELD_OUT, CALIBRATING = 5, 0, 4

#: Kinds of packed rows: pair counts, word counts, texts' keys and word features, texts' pairs, texts' sums.
PAIRS, WORD_COUNTS, KEYS, OF_TEXTS, SUMS = range(5)
_PAIR_WIDTHS, _WORD_WIDTHS, _TWO_WIDTHS = (5, 5, 6, 6), (5, 6, 6, 6, 6, 6), (6, 2)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def word_id(word: bytes) -> int:
    """40 bits of a word's hash, never 0, which is a text's boundary."""
    return (xxhash.xxh64_intdigest(word) >> (64 - WORD_BITS)) or 1


class WordIds(WordHashes):
    """word -> ``word_id``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = word_id(word)
        return value


_IDS = WordIds()


def pair_ids(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """48-bit number of a pair of words."""
    return (mix(v.astype(U64) * MIX_A + w.astype(U64) * MIX_B) >> U64(64 - PAIR_BITS)).astype(np.int64)


def _pairs_of(words: list[list[bytes]], ids: dict[bytes, int] = _IDS, boundary: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, word, number of pairs of each text): words between boundaries; a text without words has none."""
    some = [w for w in words if w]
    flat: list[bytes] = [x for w in some for x in w]
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(np.array([len(w) + 1 for w in some], np.int64))
    bounded = np.full(len(flat) + len(some) + 1, boundary, np.int64)  # a boundary first, and after each text
    inside = np.ones(len(bounded), bool)
    inside[0] = False
    inside[starts] = False
    bounded[inside] = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
    return bounded[:-1], bounded[1:], np.where(lengths > 0, lengths + 1, 0)


def _summed(v: np.ndarray, w: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs, sorted, and their summed counts."""
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])[: len(v)])
    return [v[starts], w[starts], *(np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in counts)]


def _counter(buckets: int):
    """(text, toxic) -> pair counts by bucket, summed in the task."""

    def passed_on(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        v, w, toxic = (np.concatenate([h[i] for h in held]) for i in range(3))
        v, w, n, of = _summed(v, w, np.ones(len(v), np.int64), toxic)
        ids = pair_ids(v, w)
        order = np.argsort(ids, kind="stable")
        found = []
        for bucket, some in _packed.ranges(ids[order], PAIR_BITS, buckets):
            rows = np.sort(order[some])  # by pair again
            found.append((bucket, PAIRS, 0, _packed.pack((_packed.steps(v[rows]), 5), (w[rows], 5), (of[rows], 6), (n[rows] - of[rows], 6))))
        return _packed.rows(found)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            for first, texts in text_pieces(batch.column(0)):
                v, w, n = _pairs_of([words_of(t) for t in texts])
                held.append((v, w, np.repeat(labels[first : first + len(texts)], n)))
                size += len(v)
                if size >= COUNTED:
                    yield from passed_on(held)
                    held, size = [], 0
        if size:
            yield from passed_on(held)

    return run


def _merger(buckets: int):
    """Pair counts of a bucket as one row, and its words' share of the word counts by range of words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _packed.grouped(batches):
            parts = [_packed.unpack(data, _PAIR_WIDTHS) for _, _, data in rows]
            v, w, toxic, plain = _summed(*(np.concatenate([np.cumsum(p[0]) if i == 0 else p[i] for p in parts]) for i in range(4)))
            found = [(bucket, PAIRS, 0, _packed.pack((_packed.steps(v), 5), (w, 5), (toxic, 6), (plain, 6)))]
            ids, at = np.unique(np.concatenate([v, w]), return_inverse=True)
            before, after = at[: len(v)], at[len(v) :]
            total = lambda which, x: np.bincount(which, x, len(ids)).astype(np.int64)
            sums = [total(after, toxic), total(after, plain), total(before, toxic > 0), total(before, plain > 0), total(after, np.ones(len(w)))]
            for part, some in _packed.ranges(ids, WORD_BITS, buckets):
                found.append((part, WORD_COUNTS, 0, _packed.pack((_packed.steps(ids[some]), 5), *((x[some], 6) for x in sums))))
            yield from _packed.rows(found)

    return run


@lean
def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word: counts by class, distinct words after it by class, distinct words before it."""
    for _, rows in _packed.grouped(batches):
        parts = [_packed.unpack(data, _WORD_WIDTHS) for _, _, data in rows]
        ids, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([p[i] for p in parts]), len(ids)).astype(np.int64) for i in range(1, 6)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums)], ["id", "n0", "n1", "t0", "t1", "before"])


@dataclass
class Totals:
    """Sums over the word table: class 0 is the toxic, class 1 the ordinary one."""

    tokens: tuple[float, float]
    kinds: tuple[float, float]
    once: tuple[float, float]  # words seen once
    words: int
    known: int  # words seen more than once
    before: float

    def backed(self, c: int, before):
        """D V / N shared(w) of a word with so many distinct words before it (a number, an array or a column)."""
        return (before + 0.5) * (DISCOUNT * self.kinds[c] / self.tokens[c] / (self.before + 0.5 * (self.words + 1)))

    def rare(self, c: int) -> float:
        """P of a word that was seen once or never: the mean of those seen once."""
        return (self.once[c] + 0.5) / (sum(self.once) + 1) / self.tokens[c]


@dataclass
class Lexicon:
    """The known words by sorted id; row ``len(ids)`` stands for all others."""

    ids: np.ndarray
    p: np.ndarray  # [2, words] P(word)
    after: np.ndarray  # [2, words] distinct words after it
    ratio: np.ndarray  # log P(word | toxic) / P(word | ordinary)
    weight: np.ndarray  # the same of its backoff weights

    @classmethod
    def of(cls, ids: np.ndarray, n: np.ndarray, after: np.ndarray, before: np.ndarray, totals: Totals) -> Lexicon:
        order = np.argsort(ids)
        ids, n, after, before = ids[order], n[:, order], after[:, order], before[order]
        p = np.stack([np.append(np.maximum(n[c] - DISCOUNT, 0) / totals.tokens[c] + totals.backed(c, before), totals.rare(c)) for c in (0, 1)])
        weight = np.where(n > 0, DISCOUNT * after / np.maximum(n, 1), 1.0)
        return cls(ids, p.astype(np.float32), after.astype(np.float32), np.log(p[0] / p[1]).astype(np.float32), np.append(np.log(weight[0] / weight[1]), 0.0).astype(np.float32))

    def rows(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.ids, ids)
        at[at == len(self.ids)] = 0
        return np.where(self.ids[at] == ids, at, len(self.ids))

    def pair_ids(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, int]:
        """A number for each pair of known words' rows, spread over all numbers of so many bits."""
        bits = max(12, len(self.ids).bit_length())
        spread = v.astype(U64)
        spread <<= U64(bits)
        spread |= w.astype(U64)
        spread *= MIX_A
        spread &= U64((1 << 2 * bits) - 1)
        return spread.view(np.int64), 2 * bits

    def gains(self, v: np.ndarray, w: np.ndarray, n: list[np.ndarray]) -> np.ndarray:
        """What counted pairs of known words add to their word's ratio and their context's weight."""
        logs = [np.log1p(np.maximum(n[c] - DISCOUNT, 0) / (DISCOUNT * np.maximum(self.after[c][v], 1)) / self.p[c][w]) for c in (0, 1)]
        return logs[0] - logs[1]

    def summed(self, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """[texts, 5]: of texts of n pairs of rows each, the lower-order sums of ``FEATURES`` and the number of words."""
        out = np.zeros((len(n), 5))
        some = n > 0
        if not some.any():
            return out
        starts = (np.cumsum(n) - n)[some]
        ratio = self.ratio[w].astype(np.float64)
        last = starts + n[some] - 1  # the closing boundary
        total = lambda x: np.add.reduceat(x, starts)
        out[some, 0] = total(ratio + self.weight[v])
        ratio[last] = 0.0
        out[some, 1] = total(ratio)
        upto = np.minimum(np.arange(len(w)) + WINDOW, np.repeat(last, n[some]))
        running = np.concatenate([[0.0], np.cumsum(ratio)])
        window = (running[upto] - running[:-1]) / WINDOW
        window[last] = -np.inf
        out[some, 2] = np.maximum.reduceat(window, starts)
        out[some, 3] = total(np.maximum(ratio - EVIDENT, 0.0))
        out[some, 4] = n[some] - 1
        return out


class Rows(dict):
    """word -> its row in a lexicon; emptied beyond ``CACHE`` entries."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = int(self.lexicon.rows(np.array([word_id(word)]))[0])
        return value


def _features(sums: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """``FEATURES`` from a text's sums."""
    n = sums[:, 4]
    words = np.maximum(n, 1)
    out = np.stack([(sums[:, 0] + gains) / (n + 1), sums[:, 1] / words, sums[:, 2], np.sqrt(sums[:, 3] / words), np.log1p(n)], axis=1)
    return np.where(n[:, None] > 0, out, 0.0)


def _sender(shipped, buckets: int):
    """(key, text) -> the texts' keys and sums in a batch of their own, and their pairs of known words by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shipped.value
        known, row_of, boundary = len(lexicon.ids), Rows(lexicon), int(lexicon.rows(np.zeros(1, np.int64))[0])
        number = TaskContext.get().partitionId() << 32
        keys: list[bytes] = []
        sums, pairs, bits = [], [], 24

        def passed_on() -> Iterator[pa.RecordBatch]:
            found = [(((number >> 32) + number) % buckets, KEYS, number, b"".join(keys) + np.concatenate(sums).astype("<f4").tobytes())]
            pair = np.concatenate(pairs)
            pairs.clear()
            pair.sort()
            owner = (pair & 0xFFFF).astype(np.uint16)
            pair >>= 16
            for bucket, some in _packed.ranges(pair, bits, buckets):
                found.append((bucket, OF_TEXTS, number, _packed.pack((_packed.steps(pair[some]), 6), (owner[some], 2))))
            return _packed.rows(found)

        size = 0
        for batch in batches:
            of = batch.column(0).to_pylist()
            for first, texts in text_pieces(batch.column(1)):
                if keys and (size >= FLUSH or len(keys) + len(texts) > TEXTS):
                    yield from passed_on()
                    keys, sums, pairs, size, number = [], [], [], 0, number + 1
                v, w, n = _pairs_of([words_of(t) for t in texts], row_of, boundary)
                sums.append(lexicon.summed(v, w, n))
                both = (v < known) & (w < known)
                pair, bits = lexicon.pair_ids(v[both], w[both])
                pairs.append(pair << 16 | np.repeat(np.arange(len(keys), len(keys) + len(texts)), n)[both])
                keys += of[first : first + len(texts)]
                size += len(v)
        if keys:
            yield from passed_on()

    return run


def _gains(shipped, buckets: int):
    """Counted pairs -> the gains of those of known words, by bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon: Lexicon = shipped.value
        for batch in batches:
            for data in batch.column(3).to_pylist():
                v, w, toxic, plain = _packed.unpack(data, _PAIR_WIDTHS)
                v, w = lexicon.rows(np.cumsum(v)), lexicon.rows(w)
                both = (v < len(lexicon.ids)) & (w < len(lexicon.ids))
                v, w = v[both], w[both]
                gains = np.clip(np.rint(lexicon.gains(v, w, [toxic[both], plain[both]]) * GRAIN), -32768, 32767).astype(np.int64) + 32768
                pair, bits = lexicon.pair_ids(v, w)
                order = np.argsort(pair)
                pair, gains = pair[order], gains[order]
                yield from _packed.rows([(bucket, PAIRS, 0, _packed.pack((_packed.steps(pair[some]), 6), (gains[some], 2))) for bucket, some in _packed.ranges(pair, bits, buckets)])

    return run


@lean
def _receiver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, kind): gains first, then texts' pairs, whose gains are summed by text."""
    bucket, parts, known, gains = None, [], np.zeros(0, np.int64), np.zeros(0)
    for batch in batches:
        found = []
        for at, kind, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != bucket:
                bucket, parts, known, gains = at, [], np.zeros(0, np.int64), np.zeros(0)
            if kind == PAIRS:
                parts.append(_packed.unpack(data, _TWO_WIDTHS))
                continue
            if parts:
                known, gains = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.argsort(known)
                known, gains, parts = known[order], (gains[order] - 32768) / GRAIN, []
            if kind == KEYS:
                found.append((at, kind, number, data))
            elif len(known):
                ids, owner = _packed.unpack(data, _TWO_WIDTHS)
                ids = np.cumsum(ids)
                place = np.searchsorted(known, ids)
                place[place == len(known)] = 0
                hit = known[place] == ids
                sums = np.bincount(owner[hit], gains[place[hit]])
                texts = np.flatnonzero(sums)
                if len(texts):
                    found.append((at, SUMS, number, _packed.pack((_packed.steps(texts), 2), (sums[texts].astype(np.float16).view(np.uint16), 2))))
        yield from _packed.rows(found)


@lean
def _finisher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind): each text's key and features."""
    number, keys, sums, gains = None, [], np.zeros((0, 5)), np.zeros(0)

    def out() -> pa.RecordBatch:
        found = _features(sums, gains)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(found[:, i]) for i in range(len(FEATURES)))], ["key", *FEATURES])

    for batch in batches:
        for at, kind, data in zip(*(batch.column(i).to_pylist() for i in (2, 1, 3)), strict=True):
            if at != number:
                if keys:
                    yield out()
                n = len(data) // (16 + 5 * 4)
                number, keys = at, [data[i * 16 : i * 16 + 16] for i in range(n)]
                sums, gains = np.frombuffer(data, "<f4", offset=n * 16).reshape(n, 5).astype(np.float64), np.zeros(n)
            if kind == SUMS:
                texts, sums_of = _packed.unpack(data, (2, 2))
                gains[np.cumsum(texts)] += sums_of.astype(np.uint16).view(np.float16)
    if keys:
        yield out()


@dataclass
class Model:
    """Stored counts of both classes, and the calibration."""

    pairs: DataFrame | None = None  # packed, by bucket
    words: DataFrame | None = None
    totals: Totals | None = None
    buckets: int = BUCKETS
    weights: np.ndarray | None = None  # of the standardised features, then the intercept
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    constant: float | None = None

    def drop(self) -> None:
        for table in (self.pairs, self.words):
            if table is not None:
                drop(table)


def counted(train: DataFrame, text: str, label: str) -> Model | None:
    """The uncalibrated model of ``train``; None if a class has no word."""
    size = train.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(BUCKETS, -(-size // BUCKET))
    pairs = train.select(F.col(text), F.col(label).cast("long")).mapInArrow(_counter(buckets), _packed.SCHEMA)
    pairs = stored(_packed.dealt(pairs, buckets).mapInArrow(_merger(buckets), _packed.SCHEMA), "pairs", by="kind")
    words = _packed.dealt(pairs.filter(F.col("kind") == WORD_COUNTS), buckets)
    words = stored(words.mapInArrow(_words, "id long, n0 long, n1 long, t0 long, t1 long, before long"), "words")
    drop(pairs, f"kind={WORD_COUNTS}")
    once = F.col("n0") + F.col("n1") == 1
    tokens, kinds = [F.sum(f"n{c}") for c in (0, 1)], [F.count(F.when(F.col(f"n{c}") > 0, 1)) for c in (0, 1)]
    got = words.agg(*tokens, *kinds, *[F.sum(F.when(once, F.col(f"n{c}"))) for c in (0, 1)], F.count("*"), F.count(F.when(~once, 1)), F.sum("before")).first()
    if not all(got[:2]):
        drop(pairs)
        drop(words)
        return None
    numbers = [float(x or 0) for x in got]
    kept = stored(words.filter(~once), "words")  # words seen once are known by their number alone
    drop(words)
    return Model(pairs, kept, Totals(tuple(numbers[:2]), tuple(numbers[2:4]), tuple(numbers[4:6]), got[6], got[7], numbers[8]), buckets)


def features(docs: DataFrame, model: Model, text: str = "text", most: int = WORDS) -> DataFrame:
    """``key`` (MD5 of the text) and ``FEATURES`` of each distinct text, stored."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))
    if model.totals.known > most:
        return stored(_joined(rows.dropDuplicates(["key"]), model), "features")
    ids, n0, n1, t0, t1, before = (c.to_numpy() for c in model.words.toArrow().columns)  # at most ``most`` rows
    shipped = docs.sparkSession.sparkContext.broadcast(Lexicon.of(ids, np.stack([n0, n1]), np.stack([t0, t1]), before, model.totals))
    gains = model.pairs.filter(F.col("kind") == PAIRS).mapInArrow(_gains(shipped, model.buckets), _packed.SCHEMA)
    sent = rows.mapInArrow(_sender(shipped, model.buckets), _packed.SCHEMA).unionAll(gains)
    summed = _packed.dealt(sent, model.buckets, "kind", each=1).mapInArrow(_receiver, _packed.SCHEMA)
    done = summed.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_finisher, "key binary, " + ", ".join(f"{c} double" for c in FEATURES))
    out = stored(done.groupBy("key").agg(F.max(F.struct(*FEATURES)).alias("f")).select("key", "f.*"), "features")  # equal texts once
    shipped.unpersist()
    return out


def _joined(texts: DataFrame, model: Model) -> DataFrame:
    """``features`` by joins alone, for a word table of any size."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, w, _ = _pairs_of([words_of(text)])
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(v), pa.binary()), pa.array(np.arange(len(v))), pa.array(v), pa.array(w)], ["key", "at", "v", "w"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3).to_pylist():
                v, w, toxic, plain = _packed.unpack(data, _PAIR_WIDTHS)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.cumsum(v), w, toxic, plain)], ["v", "w", "m0", "m1"])

    totals = model.totals
    p = [F.coalesce(F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / totals.tokens[c] + totals.backed(c, F.col("before")), F.lit(totals.rare(c))) for c in (0, 1)]
    weight = [F.when(F.col(f"n{c}") > 0, F.col(f"t{c}") * DISCOUNT / F.col(f"n{c}")).otherwise(1.0) for c in (0, 1)]
    context = model.words.select(F.col("id").alias("v"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), F.log(weight[0] / weight[1]).alias("weight"))
    pairs = model.pairs.filter(F.col("kind") == PAIRS).mapInArrow(unpacked, "v long, w long, m0 long, m1 long")
    rows = texts.mapInArrow(spread, "key binary, at long, v long, w long").join(context.hint("merge"), "v", "left").join(pairs.hint("merge"), ["v", "w"], "left")
    rows = rows.join(model.words.select(F.col("id").alias("w"), "n0", "n1", "before").hint("merge"), "w", "left").withColumn("p0", p[0]).withColumn("p1", p[1])
    both = F.col("a0").isNotNull() & F.col("before").isNotNull()
    gain = [F.coalesce(F.when(both, F.log1p(F.greatest(F.col(f"m{c}") - DISCOUNT, F.lit(0.0)) / (F.greatest(f"a{c}", F.lit(1)) * DISCOUNT) / F.col(f"p{c}"))), F.lit(0.0)) for c in (0, 1)]
    rows = rows.withColumn("full", F.log(F.col("p0") / F.col("p1")) + F.coalesce("weight", F.lit(0.0)) + gain[0] - gain[1])
    rows = rows.withColumn("ratio", F.when(F.col("w") != 0, F.log(F.col("p0") / F.col("p1"))))
    rows = rows.withColumn("window", F.sum("ratio").over(Window.partitionBy("key").orderBy("at").rowsBetween(0, WINDOW - 1)) / WINDOW)
    n = F.greatest(F.count("ratio"), F.lit(1))
    summed = rows.groupBy("key").agg(
        F.avg("full").alias("pairs"), F.avg("ratio").alias("words"), F.max(F.when(F.col("w") != 0, F.col("window"))).alias("window"),
        F.sqrt(F.sum(F.greatest(F.col("ratio") - EVIDENT, F.lit(0.0))) / n).alias("excess"), F.log1p(F.count("ratio")).alias("length"),
    )
    return texts.select("key").join(summed, "key", "left").select("key", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))


def _key(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def calibrate(model: Model, rows: DataFrame, found: DataFrame, text: str, label: str) -> None:
    """Logistic regression of the label on the features of ``rows``, a bounded sample; ``found`` has their features."""
    keyed = rows.select(_key(text).alias("key"), F.col(label).cast("double").alias("y"))
    got = found.join(F.broadcast(keyed), "key").select(*FEATURES, "y").toArrow()
    x = np.stack([got.column(i).to_numpy() for i in range(len(FEATURES))], axis=1)
    y = got.column(len(FEATURES)).to_numpy()
    model.centre, model.scale = np.zeros(len(FEATURES)), np.ones(len(FEATURES))
    if not 0 < y.sum() < len(y):
        model.weights = np.array([0.0, 8.0, 2.0, 4.0, 0.0, -4.0])
        return
    order = np.lexsort((y, *x.T))  # sums do not depend on the order of arrival
    x, y = x[order], y[order]
    model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.hstack([(x - model.centre) / model.scale, np.ones((len(x), 1))])
    w = np.zeros(len(FEATURES) + 1)
    for _ in range(50):  # Newton's method, lightly regularised
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w


def labelled(docs: DataFrame, known: DataFrame, text: str, bounded: bool) -> DataFrame:
    """(_text, _toxic) of the labelled documents; ``known`` is broadcast only where its size is bounded."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.join(F.broadcast(known) if bounded else known.hint("merge"), "doc_id").select("_text", "_toxic")


def _counted(docs: DataFrame, labels: DataFrame, text: str, calibration_rows: int) -> tuple[Model, DataFrame | None]:
    """The uncalibrated model, and (_text, _toxic) of the calibration sample."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("_toxic"))
    known = known.withColumn("_fold", fold()).filter(F.col("_fold") != HELD_OUT)
    n, share = known.agg(F.count("*"), F.avg("_toxic")).first()
    sample = known.filter(F.col("_fold") == CALIBRATING).orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows).select("doc_id", "_toxic")
    counting = known.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti").select("doc_id", "_toxic")
    model = counted(labelled(docs, counting, text, n <= BROADCAST_LABELS), "_text", "_toxic") if n else None
    released(docs.sparkSession)
    if model is None:
        return Model(constant=float(share or 0.0)), None
    return model, labelled(docs, sample, text, True)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """The model learnt from documents with a toxic label outside the held-out fold."""
    model, sample = _counted(docs, labels, text, calibration_rows)
    if sample is not None:
        found = features(sample, model, "_text")
        calibrate(model, sample, found, "_text", "_toxic")
        drop(found)
    return model


def fit_score(docs: DataFrame, labels: DataFrame, text: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """``score`` of ``docs`` by the model that ``fit`` learns from them: their features are taken once."""
    model, sample = _counted(docs, labels, text, calibration_rows)
    if sample is None:
        return score(docs, model, text)
    found = features(docs, model, text)
    calibrate(model, sample, found, "_text", "_toxic")
    model.drop()
    return scored(docs, model, found, text)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)."""
    if model.constant is not None:
        kept = [c for c in docs.columns if c not in ("score", "predicted")]
        return docs.select(*kept, F.lit(model.constant).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored(docs, model, features(docs, model, text), text)


def scored(docs: DataFrame, model: Model, found: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` from ``features``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    z = F.lit(float(model.weights[-1]))
    for name, weight, centre, scale in zip(FEATURES, model.weights, model.centre, model.scale, strict=False):
        z = z + (F.col(name) - float(centre)) * float(weight / scale)
    key, mark = unused(docs, "key", "score")
    scores = found.select(F.col("key").alias(key), (1 / (1 + F.exp(-z))).alias(mark))
    keyed = docs.withColumn(key, _key(text))
    return keyed.join(scores.hint("merge"), key).select(*kept, F.col(mark).alias("score"), (F.col(mark) >= 0.5).cast("int").alias("predicted"))

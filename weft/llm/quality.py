"""Quality classification by co-training.

Two views of a document: its text (shape statistics of words, symbols, repeats and lines) and its
metadata (language, source, declared length).  A logistic regression is fitted on each from the labelled
rows; over ``ROUNDS`` rounds each scores all unlabelled documents and hands the ones of which it is surest
to the other, as many as ``HANDED`` and at most one of ``SPARED`` of the pool.  Both are then calibrated on
labelled rows that neither has seen, and a logistic combination of the calibrated views scores all documents.

Only the labelled rows that are fitted on are bounded, hash-chosen samples (``LABELLED`` and ``CALIBRATION``
rows); fitting runs on the driver over their features.  The pool is every unlabelled document: its features
are stored once, and each round is one pass over them in which a task passes on its own surest rows.
Scoring is one narrow pass over whole texts.

Edge cases: a null text counts as empty and an empty text has all-zero statistics; null metadata are a
value of their own; a null n_chars counts as 0; with labels of one class only, or none, every score is
the share of good rows (0.5 without labels); without unlabelled documents, or where neither view is
confident of one, nothing is handed over and each view is that of its labelled rows (``Model.exchanged``
counts the hand-overs); a document with several label rows counts as good if most say so (ties: good); rows
with a null doc_id are scored but never learnt from; repeated rows are scored each; equal odds go to the
smaller doc_id; empty tables give empty results; other columns, whatever their names, are kept untouched and
added columns replace columns of the same names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import drop, stored, unused
from weft.llm._text import words_of

LABELLED, CALIBRATION = 12_000, 8_000
ROUNDS, HANDED, SPARED = 4, 600, 8
#: Odds (as a logarithm) from which a view is confident.
SURE = 1.0
TEXT_FEATURES, HASHED = 16, 24
FOLDS, HELD_OUT, CALIBRATING = 5, 0, 4


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def text_view(text: str | None) -> list[float]:
    """Shape statistics of a text."""
    text = text or ""
    words, n = words_of(text), len(text)
    if not words:
        return [0.0] * TEXT_FEATURES
    counts = Counter(words)
    m, kinds = len(words), len(counts)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.split()
    data = text.encode("utf-8", "replace")
    letters = sum(map(len, words))
    upper = len(data) - len(data.translate(None, _UPPER))
    digits = len(data) - len(data.translate(None, _DIGITS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    stops = len(data) - len(data.translate(None, _STOPS))
    longest = max(map(len, words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    top = max(counts.values())
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(m), letters / m, kinds / m, math.log(kinds + 1) / math.log(m + 1.01), again / m, pairs / max(1, m - 1), top / m,
        upper / len(data), digits / len(data), symbols / len(data), stops / len(data), math.log1p(longest),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(len(x) > 24 for x in raw) / max(1, len(raw)),
    ]


_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_STOPS = b".!?"


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Hashed indicators of language and source, and the declared length."""
    out = [0.0] * HASHED
    for value in (f"lang={lang}", f"source={source}"):
        out[xxhash.xxh3_64_intdigest(value) % HASHED] += 1.0
    size = math.log1p(max(0, n_chars or 0))
    return [*out, size, size * size / 10, float(size < 5.5)]


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + (ridge * len(x) / 100 + 1e-6) * np.eye(z.shape[1]), z.T @ (p - y) + ridge * len(x) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class View:
    """A standardised logistic regression."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> View:
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        return cls(centre, scale, fitted((x - centre) / scale, y))

    def logit(self, x: np.ndarray) -> np.ndarray:
        """The calibrated log-odds."""
        return self.slope * (np.clip((x - self.centre) / self.scale, -10, 10) @ self.weights[:-1] + self.weights[-1]) + self.shift

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.slope, self.shift = fitted(self.logit(x)[:, None], y, 1e-4)


@dataclass
class Model:
    text: View | None
    metadata: View | None
    both: np.ndarray
    constant: float | None = None
    exchanged: int = 0  # pseudo-labels that were handed over

    def scores(self, texts: list, langs: list, sources: list, sizes: list) -> np.ndarray:
        """[documents, 3]: combined score, text view, metadata view."""
        if self.constant is not None or not texts:
            return np.full((len(texts), 3), self.constant or 0.0)
        a = self.text.logit(np.array([text_view(t) for t in texts]))
        b = self.metadata.logit(np.array([metadata_view(*x) for x in zip(langs, sources, sizes, strict=True)]))
        return 1 / (1 + np.exp(-np.clip(np.stack([a * self.both[0] + b * self.both[1] + self.both[2], a, b], axis=1), -500, 500)))


Rows = list[tuple[int, list[float], list[float]]]  # doc_id, both views


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, pick, handed: int, rounds: int = ROUNDS) -> tuple[View, View, int]:
    """Both views after the rounds, and how many rows were handed over; ``a`` and ``b`` are the labelled rows in either view.

    ``pick(views, giver, label, n, given)`` gives the n rows of the pool, but for those of the ids ``given``, to
    which the giver's view gives that label most surely, the surest first, where it is confident.
    """
    sets = [[a, y], [b, y]]
    views = [View.of(*s) for s in sets]
    rate = float(y.mean())
    counts = (max(1, round(handed * (1 - rate))), max(1, round(handed * rate)))
    given: set[int] = set()
    for _ in range(rounds if handed else 0):
        before = len(given)
        for giver, taker in ((0, 1), (1, 0)):
            for label in (0, 1):
                rows: Rows = pick(views, giver, label, counts[label], given)
                if rows:
                    given |= {r[0] for r in rows}
                    sets[taker][0] = np.vstack([sets[taker][0], np.array([r[1 + taker] for r in rows])])
                    sets[taker][1] = np.concatenate([sets[taker][1], np.full(len(rows), float(label))])
        if len(given) == before:
            break
        views = [View.of(*s) for s in sets]
    return views[0], views[1], len(given)


_VIEWS = "id long, y double, a array<double>, b array<double>"


def _viewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, text, lang, source, n_chars) -> both views."""
    for batch in batches:
        texts, langs, sources, sizes = (c.to_pylist() for c in batch.columns[2:])
        a = [text_view(t) for t in texts]
        b = [metadata_view(*x) for x in zip(langs, sources, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a, pa.list_(pa.float64())), pa.array(b, pa.list_(pa.float64()))], ["id", "y", "a", "b"])


def _views(docs: DataFrame, y, text: str) -> DataFrame:
    """Both views of documents with a doc_id; ``y`` is the label's column."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), y.alias("y"), text, "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(_viewed, _VIEWS)


def _features(docs: DataFrame, chosen: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the label of a bounded sample (doc_id, y), by doc_id."""
    key, label = unused(docs, "id", "label")
    known = F.broadcast(chosen.select(F.col("doc_id").alias(key), F.col("y").alias(label)))
    got = _views(docs.join(known, F.col("doc_id") == F.col(key)), F.col(label), text).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["a"]))
    return np.array([r["a"] for r in got]).reshape(len(got), TEXT_FEATURES), np.array([r["b"] for r in got]).reshape(len(got), HASHED + 3), np.array([r["y"] for r in got], float)


def _surest(view: View, giver: int, label: int, n: int, given: set[int]):
    """A task's n surest rows, (strength, id, a, b)."""
    done = np.array(sorted(given), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            free = ~np.isin(ids, done)
            if not free.any():
                continue
            x = batch.column(2 + giver).flatten().to_numpy().reshape(len(ids), -1)
            strength = view.logit(x) * (1 if label else -1)
            rows = np.flatnonzero(free & (strength > SURE))
            rows = rows[np.lexsort((ids[rows], -strength[rows]))[:n]]
            new = pa.table({"strength": pa.array(strength[rows]), "id": pa.array(ids[rows]), "a": batch.column(2).take(pa.array(rows)), "b": batch.column(3).take(pa.array(rows))})
            best = new if best is None else pa.concat_tables([best, new]).sort_by([("strength", "descending"), ("id", "ascending")]).slice(0, n)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return run


def picker(pool: DataFrame):
    """``pick`` over a stored table of views."""

    def pick(views, giver: int, label: int, n: int, given: set[int]) -> Rows:
        some = pool.mapInArrow(_surest(views[giver], giver, label, n, given), "strength double, id long, a array<double>, b array<double>")
        rows = some.orderBy(F.desc("strength"), "id", "a").limit(n).collect()  # at most HANDED rows
        return [(r["id"], r["a"], r["b"]) for r in rows]

    return pick


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", labelled: int = LABELLED, calibration: int = CALIBRATION, handed: int = HANDED) -> Model:
    """The model learnt from labelled documents outside the held-out fold and all unlabelled ones."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).withColumn("f", fold()).filter(F.col("f") != HELD_OUT)
    by_hash = (F.xxhash64("doc_id"), "doc_id")
    a, b, y = _features(docs, known.filter(F.col("f") != CALIBRATING).orderBy(*by_hash).limit(labelled).select("doc_id", "y"), text)
    if not 0 < y.sum() < len(y):
        return Model(None, None, np.zeros(3), constant=float(y.mean()) if len(y) else 0.5)
    (key,) = unused(docs, "id")
    unknown = docs.join(labels.select(F.col("doc_id").alias(key)).hint("merge"), F.col("doc_id") == F.col(key), "left_anti")
    pool = stored(_views(unknown, F.lit(0.0), text), "pool")
    *views, exchanged = co_train(a, b, y, picker(pool), min(handed, pool.count() // SPARED))
    drop(pool)
    ca, cb, cy = _features(docs, known.filter(F.col("f") == CALIBRATING).orderBy(*by_hash).limit(calibration).select("doc_id", "y"), text)
    if 0 < cy.sum() < len(cy):
        views[0].calibrate(ca, cy)
        views[1].calibrate(cb, cy)
        both = fitted(np.stack([views[0].logit(ca), views[1].logit(cb)], axis=1), cy)
    else:
        both = np.array([1.0, 0.5, 0.0])
    return Model(*views, both, exchanged=exchanged)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score``, ``text_score``, ``metadata_score`` and ``predicted``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("quality_score double, text_score double, metadata_score double")
    def run(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        found = shipped.value.scores(texts.to_pylist(), langs.to_pylist(), sources.to_pylist(), sizes.to_pylist())
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(3)], ["quality_score", "text_score", "metadata_score"])

    names = ["quality_score", "text_score", "metadata_score"]
    (mark,) = unused(docs, "scored")
    out = docs.withColumn(mark, run(F.col(text), F.col("lang"), F.col("source"), F.col("n_chars").cast("long")))
    kept = [c for c in docs.columns if c not in (*names, "predicted")]
    return out.select(*kept, *[F.col(f"{mark}.{n}").alias(n) for n in names], (F.col(f"{mark}.quality_score") >= 0.5).cast("int").alias("predicted"))

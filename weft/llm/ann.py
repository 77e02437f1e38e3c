"""Approximate nearest neighbours: stable projections in a kd-tree, with a chi-square stopping test.

Vectors are projected to ``M`` dimensions by a Gaussian (2-stable) matrix: the squared projected
distance over the squared true distance is chi-square with M degrees of freedom.  Each task builds
kd-trees over the projections of at most ``CHUNK`` numbers' worth of vectors.  A query walks a tree best
first, from the root, with a heap of boxes by their least projected distance: leaves come out one after the
other in that order and their vectors are verified by true distance.  The walk ends when a vector nearer
than its k-th best would have shown itself with probability ``CONFIDENCE``: when the chi-square
distribution at (next box's projected distance / k-th best distance)^2 reaches it.  Boxes beyond are
never opened, and the k-th best of one tree holds for the task's next.

Equal vectors of a chunk are thinned before the tree: of those, no query can return more than k, the ones of
least ids other than its own.  Thus a vector that a third of the rows share costs a query no more than another.

Every vector is indexed.  Queries are searched in blocks of ``QUERIES`` (the broadcast part, of bounded
size); each block is one pass over the vectors, in which a task keeps a query's k best so far and
passes on one list a query.  Scores are true distances of the original vectors in double precision.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
neither do rows with a null id or with another dimension than the first query's; queries without k
candidates get what there is; equal distances go to the smaller id; a query's candidates are the rows
with other ids, so that rows repeated under one id never find themselves but are each found by others;
an id that is repeated among the queries is one query, with its least vector; without queries or
candidates the result is empty; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._scratch import stored

M = 8  # even: the chi-square distribution then has a closed form
LEAF = 256
CHUNK = 1 << 22  # numbers: 65,536 vectors of 64 components, 32 MB
QUERIES = 4_096
CONFIDENCE = 0.995
SEED = 29


def chi_square(x: float, m: int = M) -> float:
    """Distribution function with an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for i in range(m // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1 - math.exp(-x / 2) * total if x < 1400 else 1.0


def quantile(p: float, m: int = M) -> float:
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def projection(dimension: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, m))


@dataclass
class Tree:
    """A kd-tree over projected points.

    ``order`` lists the points so that each node's lie together, from ``start`` to ``stop``; ``low`` and ``high`` are the
    nodes' bounding boxes; an inner node's children are ``child`` and ``child + 1``, a leaf's ``child`` is 0.
    """

    order: np.ndarray
    start: list[int]
    stop: list[int]
    low: np.ndarray
    high: np.ndarray
    child: list[int]

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.arange(len(points))
        start, stop, child = [0], [len(points)], [0]
        low, high = [], []
        node = 0
        while node < len(start):
            at = order[start[node] : stop[node]]
            own = points[at]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if len(at) > leaf:
                axis = int(np.argmax(high[node] - low[node]))
                half = len(at) // 2
                order[start[node] : stop[node]] = at[np.argpartition(own[:, axis], half)]
                child[node] = len(start)
                start += [start[node], start[node] + half]
                stop += [start[node] + half, stop[node]]
                child += [0, 0]
            node += 1
        return cls(order, start, stop, np.array(low), np.array(high), child)

    def leaves(self, query: np.ndarray, limit: Callable[[], float]) -> Iterator[tuple[int, int]]:
        """Leaves (as places in ``order``) by rising least squared distance to a projected query, up to ``limit()``."""
        heap = [(0.0, 0)]
        while heap:
            gap, node = heapq.heappop(heap)
            if gap > limit():
                return
            at = self.child[node]
            if not at:
                yield self.start[node], self.stop[node]
                continue
            off = np.maximum(np.maximum(self.low[at : at + 2] - query, query - self.high[at : at + 2]), 0)
            for n, near in enumerate((off * off).sum(axis=1).tolist()):
                if near <= limit():
                    heapq.heappush(heap, (near, at + n))


class Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * queries

    def bound(self, q: int) -> float:
        d = self.found[q][0]
        return d[-1] if len(d) == self.k else math.inf

    def add(self, q: int, distance: np.ndarray, ids: np.ndarray) -> None:
        near = distance <= self.bound(q)
        if near.any():
            d, i = np.concatenate([self.found[q][0], distance[near]]), np.concatenate([self.found[q][1], ids[near]])
            order = np.lexsort((i, d))[: self.k]
            self.found[q] = (d[order], i[order])


def thinned(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that some query can return, by id.

    A query returns at most k rows of one vector, those of least ids other than its own.  So k rows of each
    id, and of those the first 2k, are enough: leaving out one id still leaves k.
    """
    rows = np.ascontiguousarray(vectors)
    _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)

    def nth(*keys: np.ndarray) -> np.ndarray:  # place of each sorted row within its run of equal keys
        new = np.any([np.r_[True, key[1:] != key[:-1]] for key in keys], axis=0)
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    order = np.lexsort((ids, same))
    order = order[nth(same[order], ids[order]) < k]
    order = order[nth(same[order]) < 2 * k]
    return np.sort(order)


def search_chunk(ids: np.ndarray, vectors: np.ndarray, queries: tuple[np.ndarray, np.ndarray, np.ndarray], best: Best, matrix: np.ndarray, stop: float) -> None:
    """Searches all queries (ids, vectors, projections) in one chunk of the index."""
    some = thinned(ids, vectors, best.k)
    ids, vectors = ids[some], vectors[some]
    tree = Tree.of(vectors @ matrix)
    ids, vectors = ids[tree.order], vectors[tree.order]
    for q in range(len(queries[0])):
        for start, end in tree.leaves(queries[2][q], lambda q=q: stop * best.bound(q) ** 2):
            own = ids[start:end]
            delta = vectors[start:end] - queries[1][q]
            distance = np.sqrt((delta * delta).sum(axis=1))
            other = own != queries[0][q]
            best.add(q, distance[other], own[other])


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _searcher(shipped, k: int, matrix: np.ndarray, stop: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shipped.value
        queries = (ids, vectors, vectors @ matrix)
        best = Best(len(ids), k)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        most = max(CHUNK // vectors.shape[1], 1)

        def flush() -> None:
            if held:
                search_chunk(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), queries, best, matrix, stop)
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if held and sum(len(h[0]) for h in held) + part.num_rows > most:
                    flush()
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                held.append((part.column(0).to_numpy(), flat.reshape(part.num_rows, -1)))
        flush()
        some = [q for q in range(len(ids)) if len(best.found[q][0])]
        if some:
            n = [len(best.found[q][0]) for q in some]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], n)), pa.array(np.concatenate([best.found[q][1] for q in some])), pa.array(np.concatenate([best.found[q][0] for q in some]))], ["query_id", "vec_id", "score"])

    return run


def _query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for row in queries.toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(vectors, np.float64)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", confidence: float = CONFIDENCE, block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found, rank from 1."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    queries = usable.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = queries.orderBy("vec_id").select(F.size("v")).first()
    if first is None:
        return empty
    usable, queries = (df.filter(F.size("v") == first[0]) for df in (usable, queries))
    matrix, stop = projection(first[0]), quantile(confidence)
    found = None
    for n, part in enumerate(_query_blocks(queries, block)):
        got = usable.mapInArrow(_searcher(spark.sparkContext.broadcast(part), k, matrix, stop), "query_id long, vec_id long, score double")
        got = got if n == 0 and len(part[0]) < block else stored(got, "neighbours")  # many blocks: each is written, so that the plan stays small
        found = got if found is None else found.unionAll(got)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

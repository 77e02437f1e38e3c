"""Distributed union-find: connected components of a graph given by its edges.

Each task first reduces its edges to a forest (path-compressed union-find over the ids of that task,
passed on whenever ``HELD`` edges have come in), then alternating large-star and small-star steps, as
joins and grouped minima, contract the forests until every node points at the smallest id of its
component.  Nothing is collected; each round is stored in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._scratch import drop, reads, stored

#: Edges that a task holds before it passes its forest on.
HELD = 500_000
ROUNDS = 60


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while (up := parent[x]) != root:
            parent[x], x = root, up
        return root

    def out() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= HELD:
            yield out()
            parent.clear()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every node of ``edges`` (two long columns) but the roots themselves.

    Self-loops, repeated and reversed edges change nothing; edges with a null end are ignored; no edges
    give no rows.
    """
    a, b = edges.columns[:2]
    state = stored(
        edges.select(F.col(a).cast("long"), F.col(b).cast("long"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .mapInArrow(_forest, "u long, v long")
        .distinct(),
        "forest",
    )
    for _ in range(ROUNDS):
        # done when every node has one parent and no parent is a child
        nodes = state.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(state.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
        odd = nodes.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)")
        if odd.isEmpty():
            break
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the grouped minima are stored, so that both sides of a join are dealt for it and a hub's edges can be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = stored(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
        lowest = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(small.filter("u != v").distinct(), "forest")
        for old in (state, least, large, lowest):
            drop(old)
        state = new
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return reads(state.select(F.col("u").alias("id"), F.col("v").alias("root")), state)

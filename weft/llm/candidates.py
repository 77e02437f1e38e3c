"""Candidate pairs from bucket keys, linear in the number of rows.

Rows are ``(key, id)``: the id was seen with the key.  Tasks send their sorted rows to ranges of keys
(``_packed``), where keys of one id are dropped; the rows of keys that a hash sample shows to be held by many
ids are dealt by id as well.  In a bucket of at most ``SMALL`` ids every pair is a candidate.  A larger
bucket, which is mostly one family of copies around an original, takes as leaders the ids that share most
buckets with others (the original agrees with more copies than the copies do among themselves), one leader
from each of ``LEADERS`` hash classes, and pairs every id with every leader.  Leaders come from grouped
maxima that are combined before the shuffle, and are stored before they are joined, so that a hot bucket's
rows can be split.

The links to leaders leave most large buckets in one component.  In the others (``settle``) all ids of
different components meet (``within``).  A bucket has a part for each ``PART`` ids, and at most ``PARTS``: ids of
its main component go to one part, the others to all, so that a bucket's rows are at most ``PARTS`` times its
ids, however many they are.  A part's task compares two pieces of ``BLOCK`` ids at a time, counts what their
sets share over inverted lists and sends on only the links that join components, so that no row is made
for a pair; it holds two pieces, and keeps the other ones in a file of its own beyond ``SPOOL`` bytes.  Ids that
share a bucket and are similar so always end in one component.  The additions grow with the ids outside
the main component times all.  ``exact=False`` instead sorts the ids by a signature of ``SIGNS`` further minima, in another
rotation for each bucket, and each id meets the ``NEXT`` following ones of other components: linear, but it
can miss links between texts near the threshold.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm import _packed
from weft.llm._scratch import drop, reads, stored
from weft.llm._text import MIX_B, U64, lean, list_array, mix
from weft.llm.components import components

SMALL = 12
LEADERS = 4
#: One id of SAMPLED is looked at for hot keys; a key is hot that HOT of these have, and one of HOT_SHARE.
SAMPLED, HOT, HOT_SHARE = 256, 8, 200
#: Minima in the signature by which unsettled ids are sorted, and following ids that each one meets.
SIGNS, NEXT = 8, 4
#: Ids of a bucket that ``within`` compares with as many others at a time; ids for each part of a bucket, and parts at most.
BLOCK, PART, PARTS = 256, 1024, 8
#: Bytes of earlier pieces that a task keeps in memory.
SPOOL = 1 << 25
#: Rows that a task holds before it sends them, and rows for each range of keys.
FLUSH, RANGE = 500_000, 1_000_000

Keys = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]
_SEEDS = mix(np.arange(1, SIGNS + 1, dtype=U64) * MIX_B)


def _sender(keys: Keys, ranges: int, hot: list[int]):
    """Batches -> distinct (key, id) rows of a task by ranges of keys; of hot keys by ranges of ids."""
    heavy = np.array(sorted(hot), np.int64).view(np.uint64)

    def passed_on(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, at = (np.concatenate([h[i] for h in held]).view(np.uint64) for i in (0, 1))
        found = []
        for kind, (low, high) in enumerate(((key, at), (at, key))):
            if len(heavy):
                some = np.isin(key, heavy) == bool(kind)
                low, high = low[some], high[some]
            elif kind:
                break
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)]
            low, high = low[new], high[new]
            spread = low if not kind else mix(low)  # ids need not be spread over the numbers
            if kind:
                order = np.argsort(spread, kind="stable")
                low, high, spread = low[order], high[order], spread[order]
            for n, part in _packed.ranges(spread, 64, ranges):
                found.append((n, kind, 0, _packed.pack((_packed.steps(low[part]), 8), (high[part], 8))))
        return _packed.rows(found)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, at in keys(batch):
                held.append((key, at))
                size += len(key)
                if size >= FLUSH:
                    yield from passed_on(held)
                    held, size = [], 0
        if size:
            yield from passed_on(held)

    return run


@lean
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of keys with more than one id, and of hot keys."""
    for _, rows in _packed.grouped(batches):
        for kind in (0, 1):
            parts = [_packed.unpack(data, (8, 8)) for k, _, data in rows if k == kind]
            if not parts:
                continue
            low, high = np.concatenate([np.cumsum(p[0].view(np.uint64)) for p in parts]), np.concatenate([p[1] for p in parts]).view(np.uint64)
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            same = low[1:] == low[:-1]
            new = np.concatenate([[True], ~same | (high[1:] != high[:-1])])
            low, high = low[new], high[new]
            same = low[1:] == low[:-1]
            kept = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | bool(kind)
            key, at = (low, high) if not kind else (high, low)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept].view(np.int64)) for x in (key, at)], ["key", "id"])


def hot_keys(keys: DataFrame) -> list[int]:
    """Keys that a large share of the ids of ``keys`` (some ids with all their keys) have: at most HOT_SHARE for each key of an id."""
    some = keys.distinct()
    found = some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT)
    ids = some.agg(F.countDistinct("id").alias("ids"))  # one row
    return [r[0] for r in found.crossJoin(F.broadcast(ids)).filter(F.col("n") * HOT_SHARE >= F.col("ids")).select("key").collect()]


def buckets(source: DataFrame, keys: Keys, each: int = 1) -> DataFrame:
    """Stored distinct ``(key, id)`` rows of keys that several ids have.

    ``source`` has a column ``id``; ``keys`` gives the (key, id) arrays of one of its batches, ``each`` keys a row.
    """
    spark = source.sparkSession

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at in keys(batch):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at)], ["key", "id"])

    some = source.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).mapInArrow(plain, "key long, id long")
    ranges = _packed.EACH * max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source.count() * each // RANGE // _packed.EACH))
    sent = source.mapInArrow(_sender(keys, ranges, hot_keys(some)), _packed.SCHEMA)
    return stored(_packed.dealt(sent, ranges).mapInArrow(_shared, "key long, id long"), "buckets")


def keyed_rows(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``Keys`` of rows (key, id)."""
    yield tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)


def paired(rows: DataFrame, small: int = SMALL, leaders: int = LEADERS) -> DataFrame:
    """The candidate pairs of ``buckets``, stored."""
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    weight = stored(rows.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("weight")), "weight")
    few = rows.join(sizes.filter(F.col("n") <= small), "key").groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    within = few.select(F.explode(F.expr("flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    many = stored(rows.join(sizes.filter(F.col("n") > small).select("key"), "key").join(weight, "id"), "many")
    order = F.struct("weight", (-F.col("id")).alias("id"))
    best = many.groupBy("key").agg(*[F.max(F.when(F.pmod(F.xxhash64("id"), F.lit(leaders)) == t, order)).alias(f"t{t}") for t in range(leaders)])
    heads = stored(best.select("key", F.array_compact(F.array(*[-F.col(f"t{t}.id") for t in range(leaders)])).alias("heads")), "heads")
    across = many.join(heads, "key").select("id", F.explode("heads").alias("head")).filter("id != head")
    across = across.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    out = stored(within.unionAll(across).distinct(), "pairs")
    for done in (sizes, weight, many, heads):
        drop(done)
    return out


def unsettled(rows: DataFrame, roots: DataFrame, small: int = SMALL) -> DataFrame:
    """``(key, id, root, n)`` of the large buckets whose ``n`` ids are in several components; of buckets of the same ids, one."""
    of = stored(rows.join(roots.hint("merge"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "of")
    each = of.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    alike = each.filter((F.col("n") > small) & (F.col("low") != F.col("high"))).groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key"))
    mixed = stored(alike.select("key", "n"), "mixed")
    out = stored(of.join(mixed.hint("merge"), "key"), "unsettled")
    drop(of)
    drop(mixed)
    return out


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, elements) -> (id, minima of SIGNS hashes of the elements)."""
    for batch in batches:
        lists = batch.column(1)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows = [mix(flat[None, i:j] ^ _SEEDS[:, None]).min(axis=1).view(np.int64) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), list_array(rows, pa.int64())], ["id", "signs"])


def near(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of ``unsettled`` ids of different components that stand near each other in the order of their signatures."""
    signs = stored(sets.mapInArrow(_signs, "id long, signs array<long>"), "signs")
    turn = F.pmod(F.xxhash64("key"), F.lit(SIGNS)).cast("int")
    order = left.join(signs.hint("merge"), "id").select("key", "id", "root", F.concat(F.slice("signs", turn + 1, SIGNS), F.slice("signs", 1, turn)).alias("order"))
    along = Window.partitionBy("key", F.col("order")[0]).orderBy("order", "id")
    after = F.array(*[F.lead(F.struct("id", "root"), n).over(along) for n in range(1, NEXT + 1)])
    pairs = order.select("id", "root", after.alias("after")).select("id", "root", F.explode("after").alias("other")).filter("other is not null and other.root != root")
    out = stored(pairs.select(F.least("id", "other.id").alias("a"), F.greatest("id", "other.id").alias("b")).distinct(), "near")
    drop(signs)
    return out


def _links_between(ids: list[int], roots: list[int], blocks: list[int], sets: list[np.ndarray], least: float, alike: Callable[[int, int], bool] | None) -> Iterator[tuple[int, int]]:
    """Links that join the components ``roots`` of ids: of pairs from different blocks, if there are two."""
    _, root, times = np.unique(np.array(roots), return_inverse=True, return_counts=True)
    if len(times) == 1:
        return
    main, block, sizes = times.argmax(), np.array(blocks), np.array([len(x) for x in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    values, elements = np.unique(np.concatenate(sets), return_inverse=True)
    owners = owners[np.argsort(elements, kind="stable")]
    starts = np.append(0, np.cumsum(np.bincount(elements, minlength=len(values))))
    ends, places, two = np.cumsum(sizes), np.arange(len(sets)), block.min() != block.max()
    parent = list(range(len(times)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in np.flatnonzero(root != main).tolist():
        common = np.bincount(np.concatenate([owners[starts[e] : starts[e + 1]] for e in elements[ends[x] - sizes[x] : ends[x]]]), minlength=len(sets))
        near = (common / (sizes[x] + sizes - common) >= least) & (root != root[x]) & ((root == main) | (places > x))
        for y in np.flatnonzero(near & (block != block[x]) if two else near).tolist():
            p, q = find(int(root[x])), find(int(root[y]))
            if p != q and (alike is None or alike(x, y)):
                parent[p] = q
                yield min(ids[x], ids[y]), max(ids[x], ids[y])


class _Pieces:
    """The rows of one part of a bucket, compared ``block`` at a time; earlier pieces lie in a file of the task beyond ``SPOOL`` bytes.

    The ids outside the bucket's main component come first, the same in each part, so that a part leaves pairs of
    pieces with no other id to the part that the pieces' numbers add up to.
    """

    def __init__(self, part: int, parts: int, least: float, alike: Callable[[object, object], bool] | None):
        self.part, self.parts, self.least, self.alike = part, parts, least, alike
        self.file, self.starts, self.pure = tempfile.SpooledTemporaryFile(SPOOL), [], []
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def _meet(self, ids: list[int], roots: list[int], blocks: list[int], sets: list[np.ndarray], texts: list) -> None:
        now, of = [self._find(r) for r in roots], dict(zip(ids, roots, strict=True))
        same = None if self.alike is None else lambda x, y: self.alike(texts[x], texts[y])
        for a, b in _links_between(ids, now, blocks, sets, self.least, same):
            x, y = self._find(of[a]), self._find(of[b])
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))

    def add(self, rows: list[tuple], main: int) -> None:
        """Compare a piece's rows (id, root, elements, body) with each other and with all earlier ones."""
        if not rows:
            return
        n, ids, roots, sets, texts = len(self.starts), *map(list, zip(*rows, strict=True))
        pure = main not in roots
        mine = lambda i: not (pure and self.pure[i]) or (i + n) % self.parts == self.part
        for i, start in enumerate(self.starts):
            if mine(i):
                self.file.seek(start)
                held = pickle.load(self.file)
                self._meet(*(x + y for x, y in zip(held[:2], (ids, roots), strict=True)), [0] * len(held[0]) + [1] * len(ids), held[2] + sets, held[3] + texts)
        if roots[0] == main:  # ids of the main component only: nothing later is to meet them
            return
        self.starts.append(self.file.seek(0, 2))
        self.pure.append(pure)
        if mine(n):
            self._meet(ids, roots, [0] * len(ids), sets, texts)
        pickle.dump((ids, roots, sets, texts), self.file, pickle.HIGHEST_PROTOCOL)


def within(left: DataFrame, bodies: DataFrame, least: float, sets_of: Callable[[pa.Array], list[np.ndarray]], alike: Callable[[object, object], bool] | None = None) -> DataFrame:
    """Links that join the components of ``unsettled`` ids wherever two ids of one bucket are similar.

    ``bodies`` has ``id, body``; ``sets_of`` gives the distinct elements of bodies, whose Jaccard similarity must reach
    ``least``; where that is only a bound, ``alike`` decides on two bodies.
    """
    block = BLOCK

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, pieces, held, main = None, None, [], None

        def found() -> pa.RecordBatch:
            pieces.add(held, main)
            pieces.file.close()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in pieces.links], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                keys, parts, counts, mains, ids, roots = (some.column(i).to_pylist() for i in range(6))
                texts = some.column(6).to_pylist() if alike else [None] * len(ids)
                for key, part, count, top, *row in zip(keys, parts, counts, mains, ids, roots, sets_of(some.column(6)), texts, strict=True):
                    if (key, part) != cell:
                        if pieces:
                            yield found()
                        cell, pieces, held, main = (key, part), _Pieces(part, count, least, alike), [], top
                    held.append(row)
                    if len(held) == block:
                        pieces.add(held, main)
                        held = []
        if pieces:
            yield found()

    sizes = left.groupBy("key", "root").agg(F.count("*").alias("n"))
    mains = stored(sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top")).select("key", F.col("top.root").alias("main")), "mains")
    parts = F.least(F.ceil(F.col("n") / PART), F.lit(PARTS)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = left.join(mains.hint("merge"), "key").withColumn("parts", parts)
    sent = F.when(F.col("root") == F.col("main"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = dealt.select("key", F.explode(sent).alias("part"), "parts", "main", "id", "root")
    rows = cells.join(bodies.hint("merge"), "id").select("key", "part", "parts", "main", "id", "root", "body")
    in_order = rows.repartition("key", "part").sortWithinPartitions("key", "part", F.col("root") == F.col("main"), "id")
    out = stored(in_order.mapInArrow(run, "a long, b long").distinct(), "within")
    drop(mains)
    return out


def elements_of(lists: pa.Array) -> list[np.ndarray]:
    """Arrow lists of longs as numpy rows."""
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def settle(rows: DataFrame, pairs: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], least: float, exact: bool = True, joined: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified links and ``components`` of ``buckets`` and their ``paired``.

    ``verify`` keeps and stores the links of a table of pairs; ``sets`` gives ``(id, elements)``, the distinct
    elements of the ids of a table, whose Jaccard similarity bounds the verified one.  ``joined`` is ``within`` of
    unsettled rows, for operators that have smaller bodies than sets, or more to ask of a pair.
    """
    links = verify(pairs)
    roots = components(links.select("a", "b"))
    left = unsettled(rows, roots)
    if not left.isEmpty():
        if exact:
            join = joined or (lambda rows: within(rows, sets(rows.select("id").distinct()).select("id", F.col("elements").alias("body")), least, elements_of))
            more = join(left)
            found = verify(more)
        else:
            more = near(left, sets(left.select("id").distinct()))
            found = verify(more.join(pairs.hint("merge"), ["a", "b"], "left_anti"))
        drop(more)
        if not found.isEmpty():
            old, roots = roots, components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionAll(found.select("a", "b")))
            drop(old)
            links = reads(links.unionAll(found), links, found)
    drop(left)
    return links, roots

"""The training-data operators against brute force, round trips, held-out accuracy and edge cases."""

import math
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import SF_DIR, difference
from weft.llm import ann, candidates, components, decontaminate, language_id, license_scan, line_dedup, mixing, order_minhash, quality, queries, token_counts, toxicity
from weft.llm._text import words_of
from weft.sources.tables import table

MID = "/root/testdata/sf0.01"
WORDS = [a + b for a in ("ta", "ri", "mo", "ke", "su", "lan", "por", "vi") for b in ("ne", "do", "ful", "ga", "shi", "ber", "x", "ly")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return df.withColumn("keep", F.lit(1)).withColumn("class", F.lit(2)).withColumn("root", F.lit(3)) if extra else df


# components and candidates


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = {x: r for x, r in union_find([e for e in edges if None not in e]).items() if x != r}
    assert got == want


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def paired(spark, rows):
    return candidates.paired(candidates.buckets(spark.createDataFrame(rows, "key long, id long"), candidates.keyed_rows))


def test_candidates_small_buckets_are_complete(spark):
    rows = [(k, i) for k in range(30) for i in random.Random(k).sample(range(60), 7)]
    rows += rows[:50]
    got = {(r.a, r.b) for r in paired(spark, rows).collect()}
    by = defaultdict(set)
    for k, i in rows:
        by[k].add(i)
    assert got == {(a, b) for s in by.values() for a in s for b in s if a < b}


def test_candidates_grow_linearly_and_reach_the_centre(spark):
    """In a large bucket every id meets the one that shares most buckets with others."""
    rows = [(k, 0) for k in range(8)] + [(k, i) for i in range(1, 400) for k in range(8) if (i * 7 + k) % 5]
    pairs = {(r.a, r.b) for r in paired(spark, rows).collect()}
    assert all((0, i) in pairs for i in range(1, 400))
    assert len(pairs) < 400 * 8 * candidates.LEADERS


def test_buckets_equal_brute_force(spark, monkeypatch):
    """Shared keys over the whole range of numbers, whatever the tasks; a hot key's rows are dealt by id."""
    rng = random.Random(29)
    rows = [(-5, i) for i in range(3000)] + [(rng.randrange(-(1 << 63), 1 << 63), -i) for i in range(3000)]
    rows += [(k, rng.randrange(-9, 3000)) for k, _ in rng.sample(rows, 500)] + rng.sample(rows, 300)
    by = defaultdict(set)
    for k, i in rows:
        by[k].add(i)
    want = sorted((k, i) for k, s in by.items() if len(s) > 1 for i in s)
    df = spark.createDataFrame(rows, "key long, id long").repartition(5)
    monkeypatch.setattr(candidates, "SAMPLED", 8)
    assert candidates.hot_keys(df) == [-5]
    assert sorted(map(tuple, candidates.buckets(df, candidates.keyed_rows).collect())) == want
    monkeypatch.setattr(candidates, "HOT", 1 << 40)
    assert sorted(map(tuple, candidates.buckets(df, candidates.keyed_rows).collect())) == want
    assert candidates.buckets(df.limit(0), candidates.keyed_rows).collect() == []


# 1 decontamination


def least_edits(item, text):
    previous = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(previous[j - 1] + (c != d), previous[j] + 1, row[j - 1] + 1)
        previous = row
    return min(previous)


def test_decontamination_equals_edit_distance():
    rng = random.Random(5)
    items = [sentence(rng, rng.randrange(14, 40)).encode() for _ in range(12)]
    index = decontaminate.Index.of(list(range(12)), items)
    for _ in range(120):
        i = rng.randrange(12)
        text = bytearray(items[i])
        for _ in range(rng.randrange(0, 2 * int(index.edits[i]) + 2)):
            p = rng.randrange(len(text))
            how = rng.random()
            if how < 0.4:
                text[p] = rng.choice(b"abcxyz")
            elif how < 0.7:
                del text[p]
            else:
                text.insert(p, rng.choice(b"abcxyz"))
        whole = sentence(rng, rng.randrange(0, 9)).encode() + b" " + bytes(text) + b" " + sentence(rng, rng.randrange(0, 9)).encode()
        truth = least_edits(items[i], whole)
        found = [h for h in index.search([b"other text here", whole, b"x"]) if h[1] == i]
        assert bool(found) == (truth <= index.edits[i])
        if found:
            assert found[0][0] == 1
            assert found[0][4] == truth


def test_decontamination_edges(spark):
    docs = documents(spark, [(1, "x " + "benchmark passage that must not be learnt by any model " * 2), (2, None), (3, ""), (4, "!!! ..."), (5, "tiny one"), (5, "tiny one"), (None, "tiny one")], extra=True)
    bench = spark.createDataFrame([(1, "Benchmark passage, that must not be learnt by any model"), (2, "Tiny"), (3, None), (4, ""), (5, "tiny")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(-1, 2), (-1, 5), (1, 1), (1, 1), (5, 2), (5, 2), (5, 5), (5, 5)]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert decontaminate.matches(docs, bench.limit(0)).collect() == []
    assert decontaminate.matches(docs.limit(0), bench).collect() == []
    assert sorted((r.doc_id or -1, r.item_id) for r in decontaminate.matches(docs, bench, block=10).collect()) == got  # many blocks


# 2 line dedup


def test_lines_equal_brute_force(spark):
    rng = random.Random(7)
    base = [sentence(rng, rng.randrange(6, 30)) for _ in range(40)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(base).split()
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            lines.append(" ".join(line))
        rows.append((d, "\n".join([*lines, ""])))
    docs = documents(spark, rows)
    lines = defaultdict(list)
    for d, text in rows:
        for n, line in enumerate(line_dedup.normal_lines(text)):
            if line:
                lines[line].append((d, n))
    names = list(lines)
    sets = [line_dedup.shingles(x) for x in names]
    root = union_find([(i, i) for i in range(len(names))] + [(j, i) for i in range(len(names)) for j in range(i) if line_dedup.jaccard(sets[i], sets[j]) >= 0.8])
    classes = defaultdict(list)
    for i, x in enumerate(names):
        classes[root[i]] += lines[x]
    want = {p: min(v) for v in classes.values() for p in v}
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(docs).collect()}
    assert got == want


def test_line_edges(spark):
    docs = documents(spark, [(1, "same line here\n\nsame line here\n ok"), (2, "SAME line, here"), (3, None), (4, ""), (None, "same line here"), (5, "a"), (6, "a")], extra=True)
    out = line_dedup.deduplicate_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text) for r in out.collect() if r.doc_id != 3)
    assert got == [(0, "same line here"), (1, "same line here\n\n ok"), (2, ""), (4, ""), (5, "a"), (6, "")]
    assert [r.text for r in out.collect() if r.doc_id == 3] == [None]
    assert line_dedup.line_classes(docs.limit(0)).collect() == []


# 3 neighbours


def exact_neighbours(rows, queries, k=10):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows])
    out = {}
    for q, v in queries:
        d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        other = ids != q
        order = np.lexsort((ids[other], d[other]))[:k]
        out[q] = [(int(i), float(x)) for i, x in zip(ids[other][order], d[other][order], strict=True)]
    return out


def test_tree_yields_leaves_in_order():
    points = np.random.default_rng(5).standard_normal((700, 8))
    points[100:300] = points[7]
    tree, query = ann.Tree.of(points, 16), points[3] + 0.1
    gaps, seen = [], []
    for start, stop in tree.leaves(query, lambda: math.inf):
        own = points[tree.order[start:stop]]
        off = np.maximum(np.maximum(own.min(axis=0) - query, query - own.max(axis=0)), 0)
        gaps.append((off * off).sum())
        seen += tree.order[start:stop].tolist()
    assert sorted(seen) == list(range(700)) and gaps == sorted(gaps)
    near = [x for a, b in tree.leaves(query, lambda: 2.0) for x in tree.order[a:b]]
    assert set(np.flatnonzero(((points - query) ** 2).sum(axis=1) <= 2)) <= set(near) and len(near) < 700


def test_equal_vectors_lose_no_answer():
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((20, 6))[rng.integers(0, 20, 900)]
    ids = rng.integers(0, 300, 900)  # repeated ids and repeated vectors
    kept = ann.thinned(ids, vectors, 4)
    assert len(kept) <= 20 * 8
    for own in range(0, 300, 7):
        query = vectors[own]

        def best(some):
            d = np.sqrt(((vectors[some] - query) ** 2).sum(axis=1))
            return sorted((x, i) for x, i in zip(d.tolist(), ids[some].tolist(), strict=True) if i != own)[:4]

        assert best(kept) == best(np.arange(900))


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24)) * 3
    rows = [(i, (centres[i % 30] + rng.normal(size=24)).astype(np.float32).astype(float)) for i in range(3000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(5)
    want = exact_neighbours(rows, [r for r in rows if r[0] % 100 == 0])
    got = defaultdict(list)
    for r in ann.neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert set(got) == set(want)
    assert hits / sum(map(len, want.values())) >= 0.95
    assert all(abs(dict(want[q]).get(i, s) - s) < 1e-12 for q in want for i, s in got[q])
    blocks = ann.neighbours(df, F.col("vec_id") % 100 == 0, block=7)
    assert sorted(map(tuple, blocks.collect())) == sorted((q, n, i, s) for q in got for n, (i, s) in enumerate(got[q], 1))


def test_every_oracle_is_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())


def test_neighbour_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.neighbours(df, F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]
    assert ann.neighbours(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert abs(ann.chi_square(ann.quantile(0.95)) - 0.95) < 1e-9


# 4 mixing


def test_mixing_equals_sql(spark):
    assert difference(queries.QUERIES["op4_mix_sources"](spark, MID), queries.ORACLES["op4_mix_sources"], MID) == ""


def test_mixing_meets_budget_and_repeats(spark):
    rng = random.Random(11)
    rows = [(i, sentence(rng, 5 + i % 7), "en", "big" if i < 600 else "mid" if i < 680 else "small" if i < 690 else None) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, entropy=1.0, repeats=3.0).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", "block", "weight", "mix_order").collect()
    have, copies, used = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, _, s in rows:
        have[s or ""] += len(t.split())
    weight = {}
    for r in got:
        copies[r.doc_id] += 1
        used[r.source] += len(r.text.split())
        weight[r.source] = r.weight
        assert 0 <= r.mix_order < 1.2
    total = sum(have.values())
    assert max(copies.values()) <= 3
    for s, w in weight.items():
        assert used[s] <= w * total + 1
        assert used[s] > w * total - 15
    assert len({(r.doc_id, r.block) for r in got}) == len(got)


def test_mixing_edges(spark):
    docs = documents(spark, [(1, "a b"), (2, None), (3, "")], extra=True).withColumn("weight", F.lit(9))
    assert sorted(r.doc_id for r in mixing.mix(docs).collect() if r.doc_id == 1) == [1]
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mix(docs.filter("doc_id > 1")).collect() == []
    assert mixing.mix(docs).columns == [c for c in docs.columns if c != "weight"] + list(mixing.ADDED)


def test_mixing_with_many_sources_is_salted(spark, monkeypatch):
    docs = table(spark, SF_DIR, "documents", "doc_id", "source", "text")
    rows = lambda: sorted(map(str, mixing.mix(docs).drop("text").collect()))
    want = rows()
    monkeypatch.setattr(mixing, "with_key_table", lambda a, b, key: __import__("weft.llm._scratch", fromlist=["x"]).with_key_table(a, b, key, limit=0))
    assert rows() == want


# 5 toxicity


def test_toxicity_held_out(spark):
    scored = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    held = [r for r in table(spark, "/root/testdata/sf0.1", "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(scored[r.doc_id].held_out for r in held)
    assert np.mean([scored[r.doc_id].predicted == r.toxic for r in held]) > 0.95
    clean = [scored[r.doc_id].predicted for r in held if not r.toxic]
    assert np.mean(clean) < 0.02


def test_toxicity_edges(spark):
    docs = documents(spark, [(i, ("vile " if i % 2 else "fine ") * 3 + "words go here") for i in range(60)] + [(100, None), (101, ""), (None, "vile vile")], extra=True).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 63
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert next(r.score for r in rows if r.doc_id == 1) > next(r.score for r in rows if r.doc_id == 2)
    for some, share in ((labels.filter("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()} == {share}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def plain_features(train, texts):
    """The model recounted in plain dictionaries, and a text's features by the formulas."""
    n, pairs = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for text, toxic in train:
        words = words_of(text)
        if words:
            for v, w in zip([0, *words], [*words, 0], strict=True):
                n[1 - toxic][w] += 1
                pairs[1 - toxic][v, w] += 1
    every, both = {**n[0], **n[1]}, {**pairs[0], **pairs[1]}
    after = [defaultdict(int), defaultdict(int)]
    before = defaultdict(int)
    for c in (0, 1):
        for v, _ in pairs[c]:
            after[c][v] += 1
    for _, w in both:
        before[w] += 1
    known = {w for w in every if n[0][w] + n[1][w] > 1}
    once = [sum(n[c][w] for w in every if w not in known) for c in (0, 1)]
    tokens, kinds, d = [sum(x.values()) for x in n], [sum(v > 0 for v in x.values()) for x in n], 0.75

    def single(c, w):
        if w not in known:
            return (once[c] + 0.5) / (sum(once) + 1) / tokens[c]
        return max(n[c][w] - d, 0) / tokens[c] + d * kinds[c] / tokens[c] * (before[w] + 0.5) / (len(both) + 0.5 * (len(every) + 1))

    def pair(c, v, w):
        if v not in known or not n[c][v]:
            return single(c, w)
        seen = max(pairs[c][v, w] - d, 0) if w in known else 0.0
        return seen / n[c][v] + d * after[c][v] / n[c][v] * single(c, w)

    out = []
    for text in texts:
        words = words_of(text)
        if not words:
            out.append([0.0] * 5)
            continue
        full = [np.log(pair(0, v, w) / pair(1, v, w)) for v, w in zip([0, *words], [*words, 0], strict=True)]
        low = [np.log(single(0, w) / single(1, w)) for w in words]
        window = max(sum(low[i : i + 4]) / 4 for i in range(len(low)))
        out.append([np.mean(full), np.mean(low), window, np.sqrt(np.mean([max(x - 2, 0) for x in low])), np.log1p(len(words))])
    return np.array(out)


def test_toxicity_features_equal_a_plain_recount(spark, monkeypatch):
    """By buckets and, for a word table too large to broadcast, by joins; in many small batches."""
    rng = random.Random(31)
    train = [(sentence(rng, rng.randrange(0, 30)) + (" vile x" if toxic else " fine y") + f" only{i}", toxic) for i in range(120) for toxic in [int(rng.random() < 0.3)]]
    train += [("", 1), ("vile", 1)]
    texts = [t for t, _ in train[:30]] + [sentence(rng, 40) + " unheard vile", "", "unheard", None, "vile vile vile", " ".join(WORDS * 50)]
    want = plain_features(train, texts)
    monkeypatch.setattr(toxicity, "FLUSH", 300)
    monkeypatch.setattr(toxicity, "COUNTED", 300)
    model = toxicity.counted(spark.createDataFrame(train, "t string, y int").repartition(5), "t", "y")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    key = docs.select("doc_id", toxicity._key("text").alias("key"))
    for most in (10**6, 0):
        got = {r.doc_id: [r[c] for c in toxicity.FEATURES] for r in key.join(toxicity.features(docs, model, most=most), "key").collect()}
        assert np.allclose([got[i] for i in range(len(texts))], want, atol=0.005)


def test_toxicity_counts_grow_with_the_corpus(spark):
    rng = random.Random(41)
    few = toxicity.counted(spark.createDataFrame([("a a b", 1), ("a c c", 0)], "t string, y int"), "t", "y")
    strange = documents(spark, [(1, "none of these is known"), (2, "")])
    assert toxicity.features(strange, few).count() == 2
    sizes = []
    for n in (200, 2000):
        train = [(" ".join(f"w{rng.randrange(10**5)}" for _ in range(20)), i % 2) for i in range(n)]
        model = toxicity.counted(spark.createDataFrame(train, "t string, y int"), "t", "y")
        sizes.append(sum(len(toxicity._packed.unpack(r.data, toxicity._PAIR_WIDTHS)[0]) for r in model.pairs.filter("kind = 0").collect()))
        assert sizes[-1] == len({p for t, _ in train for p in zip(["", *t.split()], [*t.split(), ""], strict=True)})
    assert sizes[1] > 9 * sizes[0]


# 6 order MinHash


def brute_classes(rows):
    first = {}
    for i, text in sorted(rows):
        first.setdefault(b" ".join(words_of(text)), i)
    hashes = {i: order_minhash._HASHES.of(w.split()) for w, i in first.items()}
    ids = sorted(hashes)
    root = union_find([(i, first[b" ".join(words_of(t))]) for i, t in rows] + [(a, b) for n, a in enumerate(ids) for b in ids[:n] if order_minhash.similarity(hashes[a], hashes[b]) >= 0.8])
    return root


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(13)
    rows, n = [], 0
    for g in range(25):
        base = sentence(rng, rng.randrange(20, 160)).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((n, " ".join(copy)))
            n += 1
    base = sentence(rng, 200).split()
    for _ in range(60):  # one large group: copies are near the original, less so each other
        copy = list(base)
        for _ in range(4):
            copy[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((n, " ".join(copy)))
        n += 1
    rows.append((n, " ".join(base)))
    for exact in (False, True):
        got = {r.doc_id: r.class_id for r in order_minhash.classes(documents(spark, rows), exact=exact).collect()}
        assert got == brute_classes(rows)


@pytest.mark.parametrize("exact", [False, True])
def test_candidates_settle_large_buckets(spark, exact):
    """Chains and twins that no leader joins end in the components that all pairs give, for a tenth of the pairs."""
    sets = {i: list(range(i, i + 15)) if i < 200 else list(range(i // 2 * 1000, i // 2 * 1000 + 15)) for k in range(3) for i in range(k * 100, k * 100 + 40)}
    keys = spark.createDataFrame([(100 * c + k, i) for c in range(6) for k in range(3) for i in range(k * 100, k * 100 + 40)], "key long, id long")
    similar = sorted((a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])))
    rows, asked = candidates.buckets(keys, candidates.keyed_rows), []

    def verify(pairs):
        asked.append(pairs.count())
        return candidates.stored(pairs.join(spark.createDataFrame(similar, "a long, b long"), ["a", "b"]))

    of = lambda ids: ids.join(spark.createDataFrame(list(sets.items()), "id long, elements array<long>"), "id")
    led = {r.id for r in components.components(verify(candidates.paired(rows))).collect()}
    _, roots = candidates.settle(rows, candidates.paired(rows), verify, of, 0.8, exact)
    want = {x: r for x, r in union_find(similar).items() if x != r}
    got = {r.id: r.root for r in roots.collect()}
    joined = sum(got.get(a, a) == got.get(b, b) for a, b in similar)
    assert got == want if exact else joined >= 0.8 * len(similar)
    assert len(led) < len(want)  # links to leaders alone leave classes apart
    assert asked[-1] < 3 * 40 * 39 / 2 / 3


def test_sketches_agree_where_one_text_alone_repeats_a_run():
    rng = random.Random(19)
    for n in (60, 120, 300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        plain, doubled = (order_minhash._HASHES.of([w.encode() for w in x]) for x in (words, words + words[:6]))
        assert order_minhash.similarity(plain, doubled) >= 0.8
        assert len(np.intersect1d(*(order_minhash.sketch(order_minhash.kmers(h)) for h in (plain, doubled)))) >= 4


def test_similarity_is_the_aligned_share():
    h = order_minhash._HASHES.of
    a = h([w.encode() for w in WORDS[:60]])
    b = a.copy()
    b[30] = 1
    common = 26 + 25
    assert order_minhash.similarity(a, b, least=0.1) == pytest.approx(common / (112 - common))
    assert order_minhash.similarity(a, np.delete(a, 10), least=0.1) == pytest.approx((6 + 45) / (56 + 55 - 51))
    assert order_minhash.similarity(a, a) == 1.0
    assert order_minhash.similarity(a, a[::-1].copy()) == 0.0
    assert order_minhash.similarity(a, np.concatenate([a[30:], a[:30]]), least=0.8) == 0.0  # a moved half is no copy
    assert order_minhash.similarity(a[:0], a[:0]) == 1.0
    phrase = np.tile(a[:2], 400)
    assert order_minhash.similarity(np.concatenate([a[2:30], phrase]), np.concatenate([a[30:58], phrase]), least=0.05) < 0.2
    assert order_minhash.similarity(a[:3], a[:4]) == 0.0


def plain_lcs(a, b):
    previous = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(previous[j] + 1 if x == y else max(previous[j + 1], row[j]))
        previous = row
    return previous[-1]


def test_alignment_equals_the_table():
    rng = random.Random(37)
    for _ in range(300):
        kinds = rng.choice((2, 6, 40))
        a = [rng.randrange(kinds) for _ in range(rng.randrange(1, 60))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(kinds) for _ in range(rng.randrange(8))]
        want, need = plain_lcs(a, b), rng.randrange(0, 60)
        got = order_minhash.longest_common(np.array(a, np.uint64), np.array(b, np.uint64), need)
        assert got == want if want >= need else got < need


def test_long_texts_are_aligned_in_bounded_memory():
    """Twenty thousand words with moved halves, with scattered edits, and of one repeated word."""
    rng = np.random.default_rng(5)
    text = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    edited = text.copy()
    edited[::60] = 1
    start = time.monotonic()
    assert order_minhash.similarity(text, np.concatenate([text[10_000:], text[:10_000]])) == 0.0
    assert 0.8 < order_minhash.similarity(text, edited) < 0.9
    same = np.zeros(20_000, np.uint64)
    same[::9] = text[::9]
    assert order_minhash.similarity(same, np.concatenate([same[1000:], same[:400]])) > 0.8
    assert time.monotonic() - start < 60


def test_near_duplicate_edges(spark):
    long = " ".join(WORDS * 40)
    docs = documents(spark, [(1, None), (2, ""), (3, "?!"), (4, "One two"), (4, "One two"), (5, "one, TWO"), (6, long), (7, long + " end"), (None, "one two"), (8, "three")], extra=True)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    kept = order_minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 4, 6, 8]
    assert order_minhash.classes(docs.limit(0)).collect() == []


# 7 language


def test_languages_of_pages(spark):
    found = queries.QUERIES["op7_language_id"](spark, MID).collect()
    paths = {r.page_id: r.p for r in table(spark, MID, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("p")).collect()}
    assert len(found) == len(paths)
    assert np.mean([r.lang == paths[r.page_id] for r in found if paths[r.page_id]]) > 0.98
    assert all(0 < r.posterior <= 1 for r in found)


def test_language_edges(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog " * 3, "en") for i in range(20)] + [(100 + i, "der hund und die katze " * 3, "de") for i in range(20)] + [(900, None, "fr")], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(1, "http://a.example.de/x", "<html lang=de><body>der hund"), (2, None, None), (3, "http://a.example.de/y", ""), (4, "bad", "<script>the the</script><p>die katze und der hund</p>"), (4, "http://b.example.com", "<html lang='xx'>the dog and the cat")], "page_id long, url string, html string").withColumn("lang", F.lit("zz"))
    got = language_id.identify(pages, docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append((r.lang, r.declared))
    assert by[1] == [("de", "de")]
    assert sorted(by[4]) == [("de", "none"), ("en", "other")]
    assert by[3][0][0] == "de"  # nothing but its host
    assert len(by[2]) == 1
    assert language_id.identify(pages.limit(0), docs).collect() == []
    assert {r.lang for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


# 8 quality


def test_quality_held_out(spark):
    scored = {r.doc_id: r for r in queries.QUERIES["op8_quality"](spark, "/root/testdata/sf0.1").collect()}
    held = [r for r in table(spark, "/root/testdata/sf0.1", "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([scored[r.doc_id].predicted == r.quality for r in held]) > 0.96


def test_the_most_frequent_word_is_of_the_whole_text():
    opening = [f"w{i}" for i in range(10)]
    for n in (300, 3000):
        assert quality.text_view(" ".join(opening + ["spam"] * n))[6] == pytest.approx(n / (n + 10))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("junk " * 30) if i % 2 else f"a fine text number {i} with many words.", None if i % 5 == 0 else "en", f"s{i % 3}", None if i % 7 == 0 else 100) for i in range(80)] + [(200, None, None, None, None), (None, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("predicted", F.lit(5))
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(80)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 82
    assert all(0 <= r.quality_score <= 1 for r in rows)
    assert {r.quality_score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_co_training_picks_the_surest_of_all(spark):
    """Each round's rows equal a sort of the whole pool, with ties by doc_id; small pools hand over in proportion."""
    rng = np.random.default_rng(3)
    pool = [(i, 0.0, rng.integers(0, 3, 16).astype(float).tolist(), rng.integers(0, 2, 27).astype(float).tolist()) for i in range(500)]
    df = spark.createDataFrame(pool, "id long, y double, a array<double>, b array<double>").repartition(7)
    view = quality.View(np.full(16, 1.0), np.ones(16), np.array([1.0, -1.0] * 8 + [0.2]))
    odds = {r[0]: float(view.logit(np.array([r[2]]))[0]) for r in pool}
    given = {r[0] for r in pool[::9]}
    for label, sign in ((0, -1), (1, 1)):
        want = [i for i in sorted(odds, key=lambda i: (-sign * odds[i], i)) if i not in given and sign * odds[i] > quality.SURE][:40]
        assert [r[0] for r in quality.picker(df)((view, None), 0, label, 40, given)] == want
    rows = [(i, ("junk " * 30) if i % 2 else f"a fine text number {i} with many different words in it.", "en", "good" if i % 2 == 0 else "bad", 100) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(100)], "doc_id long, quality int")
    assert quality.fit(docs, labels).exchanged > 0
    assert quality.fit(docs.filter("doc_id < 100"), labels).exchanged == 0


# 9 token counts


def test_edits_equal_full_encoding():
    rng = random.Random(17)
    count = token_counts.counter()
    bits = ["a", " ", "  ", "\n", "é", "1", "'s", "!", " the", "x y", "", " \n ", "\t", "9 9", " word", " Zed"]
    for _ in range(600):
        tree = token_counts.SegmentTree("".join(rng.choice(bits) for _ in range(rng.choice([0, 5, 60, 300]))), count, rng.choice([4, 16, 64]))
        for _ in range(3):
            now, edits, p = tree.text, [], 0
            for _ in range(rng.randrange(4)):
                p += rng.randrange(0, 30)
                if p > len(now):
                    break
                q = min(len(now), p + rng.randrange(0, 20))
                edits.append((p, q, "".join(rng.choice(bits) for _ in range(rng.randrange(4)))))
                p = q + 1
            want = now
            for a, b, s in reversed(edits):
                want = want[:a] + s + want[b:]
            tree.apply(edits)
            assert tree.text == want
            assert tree.total == sum(tree.leaves()) == count(want)


def test_edits_touch_little(spark):
    text = " ".join(WORDS * 300)
    tree = token_counts.SegmentTree(text, token_counts.counter())
    before = tree.encoded
    tree.apply([(len(text) // 2, len(text) // 2 + 4, "gone")])
    assert tree.encoded - before < 4 * token_counts.SEGMENT
    with pytest.raises(ValueError, match="overlap"):
        tree.apply([(0, 5, ""), (3, 8, "")])


def test_token_count_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "mail me a.b@c.example.com now 123456789012"), (3, "plain")], extra=True).withColumn("tree", F.lit(1))
    rows = token_counts.counted(docs, keep_tree=True).collect()
    count = token_counts.counter()
    assert {(r.n_tokens, r.n_tokens_edited, r.n_edits) for r in rows if r.doc_id < 3} == {(0, 0, 0)}
    assert [(r.n_tokens, r.n_tokens_edited) for r in rows if r.n_edits == 2] == [(count("mail me a.b@c.example.com now 123456789012"), count("mail me [mail] now [number]"))]
    edits = docs.withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("yo ho").alias("text"))))
    assert sorted(r.n_tokens_edited for r in token_counts.counted(edits, edits="edits").collect()) == sorted([count("yo ho")] * 2 + [count("yo hoil me a.b@c.example.com now 123456789012"), count("yo hoain")])
    assert token_counts.counted(docs.limit(0)).collect() == []


def test_kept_trees_encode_only_what_edits_touch(spark):
    """Three runs of edits on stored trees: the counts of a full encoding, for the characters of a few segments."""
    rng, count = random.Random(43), token_counts.counter()
    texts = {i: " ".join(rng.choice(WORDS) for _ in range(4000)) for i in range(5)} | {7: "", 8: None}
    docs = token_counts.counted(spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("e", F.lit(None).cast("array<struct<start:int,end:int,text:string>>")), edits="e", keep_tree=True).drop("e")
    for _ in range(3):
        edits = {i: [(p, p + 5, rng.choice(["", " new words here", "x"])) for p in sorted(rng.sample(range(0, max(1, len(t or "")), 50), 3 if t else 0))] for i, t in texts.items()}
        rows = spark.createDataFrame([(i, e) for i, e in edits.items()], "doc_id long, e array<struct<start:int,end:int,text:string>>")
        docs = candidates.stored(token_counts.recounted(docs.join(rows, "doc_id"), "e").drop("e"))
        for i, e in edits.items():
            for a, b, s in reversed(e):
                texts[i] = texts[i][:a] + s + texts[i][b:]
        for r in docs.collect():
            assert r.text == texts[r.doc_id]
            assert r.n_tokens_edited == count(r.text or "") == sum(r.tree.counts)
            assert r.n_chars_reencoded <= 3 * 4 * token_counts.SEGMENT
            assert r.error is None


def test_bad_edits_are_reported(spark):
    kind = "array<struct<start:int,end:int,text:string>>"
    bad = [(1, [(0, 5, "a"), (3, 8, "b")], "edits overlap"), (2, [(6, 2, "a")], "an edit ends before it starts"), (3, [(None, 2, "a")], "an edit has no place"), (4, [None], "an edit has no place"), (5, None, None), (6, [(0, 900, None)], None)]
    docs = spark.createDataFrame([(i, "some words to count", e) for i, e, _ in bad], f"doc_id long, text string, e {kind}")
    rows = {r.doc_id: r for r in token_counts.counted(docs, edits="e").collect()}
    assert {i: rows[i].error for i in rows} == {i: error for i, _, error in bad}
    assert all(rows[i].n_tokens_edited == rows[i].n_tokens for i in range(1, 6))
    assert rows[6].n_tokens_edited == 0


# 10 licences


def base_by_hand(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in starts]
    return len(words), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts}))


def test_license_base_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, MID, "documents").collect()}
    for r in queries.QUERIES["op10_license_scan"](spark, MID).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_by_hand(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the MIT license", "mit"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("under the GNU General Public License, version 3", "gpl"),
        ("released under the GNU General Public License v3", "gpl,gpl-3.0"),
        ("CC-BY 4.0 cc by", "cc-by"),
        ("see https://www.gnu.org/licenses/gpl-3.0", "gpl-3.0"),
        ("mit dem Hund", ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
        ("you may not use this file except in compliance with the License.", "apache-2.0"),
        ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "gpl,lgpl-2.1"),
        ("The Software shall be used for Good, not Evil.", "json"),
        ("This work is licensed under a Creative Commons Attribution 3.0 Unported", "cc-by,cc-by-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike Licence", "cc-by-sa"),
        (None, ""),
    ],
)
def test_license_labels(text, labels):
    assert license_scan.scan(text)["labels"] == labels


def test_license_rules():
    rules = license_scan.rules()
    assert len(rules) > 200
    assert all(0 < r.confidence < 1 for r in rules)
    bodies = [line.split("|", 2) for line in license_scan.BODIES.strip().splitlines()]
    assert len(bodies) > 50 and all(keyword in pattern for _, keyword, pattern in bodies)
    many = license_scan.scan("cc by " * 30_000)
    assert many["n_base"] == 30_000
    assert many["last_word"] == 59_998


def test_license_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "cc by"), (3, "cc by")], extra=True).withColumn("score", F.lit("x"))
    assert sorted((r.doc_id, r.n_base) for r in license_scan.scan_licenses(docs).collect()) == [(1, 0), (2, 0), (3, 1), (3, 1)]
    assert license_scan.scan_licenses(docs.limit(0)).collect() == []


# all ten: columns of any name


CLASHING = ("id", "gone", "key", "score", "n", "full", "rest", "cells", "goal", "last", "y", "label", "scan", "scored", "counted", "copies", "cell", "weight", "text_", "keys", "same", "root", "bucket", "kind", "batch", "data", "tree", "error", "cs")


def test_extra_columns_may_have_any_name(spark):
    rng = random.Random(47)
    rows = [(i, sentence(rng, 30) + (" vile" if i % 3 == 0 else "") + "\n" + sentence(rng, 8), "en", f"s{i % 2}", 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit(f"kept {name}")).withColumn(f"_{name}", F.lit(f"kept _{name}"))
    docs = candidates.stored(docs)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 2)) for i in range(40)], "doc_id long, toxic int, quality int")
    benchmark = spark.createDataFrame([(1, rows[5][1])], "item_id long, text string")
    vectors = docs.withColumn("embedding", F.array(F.col("doc_id").cast("double"), F.lit(1.0))).withColumn("vec_id", F.col("doc_id"))
    found = {
        "op1": decontaminate.decontaminate(docs, benchmark),
        "op2": line_dedup.deduplicate_lines(docs),
        "op4": mixing.mix(docs),
        "op5": toxicity.fit_score(docs, labels),
        "op6": order_minhash.deduplicate(docs),
        "op8": quality.score(docs, quality.fit(docs, labels)),
        "op9": token_counts.counted(docs),
        "op10": license_scan.scan_licenses(docs),
    }
    added = {"op4": mixing.ADDED, "op5": ("score", "predicted"), "op8": ("quality_score", "text_score", "metadata_score", "predicted"), "op9": [f[0] for f in token_counts._FIELDS], "op10": license_scan.ROW.names}
    for op, df in found.items():
        row = df.first()
        mine = added.get(op, ())
        assert all(row[c] == f"kept {c}" for c in docs.columns[5:] if c not in mine), op
    assert decontaminate.matches(docs, benchmark).count() == 1
    assert ann.neighbours(vectors, F.col("vec_id") == 3, 2).count() == 2
    pages = docs.select("*", F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))
    assert language_id.identify(pages, docs).count() == 40


def test_links_between_components_are_all_found():
    """Half-similar families in one bucket, whole and in blocks, against all pairs."""
    rng = random.Random(11)
    base = list(range(100))
    sets = []
    for _ in range(60):
        one = list(base)
        for i in rng.sample(range(100), rng.choice((4, 8, 15))):
            one[i] = rng.randrange(1000, 1100)
        sets.append(np.unique(np.array(one, np.uint64)))
    roots = [rng.choice((0, 0, 0, i)) for i in range(60)]
    close = lambda x, y: line_dedup.jaccard(sets[x], sets[y]) >= 0.8
    pairs = [(x, y) for x in range(60) for y in range(x) if close(x, y)]
    same = [(i, 100 + r) for i, r in enumerate(roots)]
    for blocks in ([0] * 60, [i % 2 for i in range(60)]):
        met = [p for p in pairs if len(set(blocks)) == 1 or blocks[p[0]] != blocks[p[1]]]
        for alike in (None, lambda x, y: (x + y) % 3 > 0):
            found = list(candidates._links_between(list(range(60)), roots, blocks, sets, 0.8, alike))
            assert all(close(*p) and roots[p[0]] != roots[p[1]] for p in found)
            wanted = [p for p in met if roots[p[0]] != roots[p[1]] and (alike is None or alike(*p))]
            assert union_find(found + same) == union_find(wanted + same)
            assert len(found) < len(set(roots))


def test_a_large_bucket_loses_no_link(spark, monkeypatch):
    """A bucket of several blocks whose ids are in pairs that no leader joins: every pair is linked by default."""
    monkeypatch.setattr(candidates, "BLOCK", 16)
    rng = random.Random(4)
    rows = []
    for i in range(120):
        one = [7 * j for j in range(30)] + [1000 * (i + 1) + j for j in range(30)]  # half of each set is common to all
        rows += [(2 * i, one), (2 * i + 1, [*one[:-1], -1 - i])]
    rng.shuffle(rows)
    elements = candidates.stored(spark.createDataFrame(rows, "id long, elements array<long>"))
    keys = candidates.buckets(spark.createDataFrame([(5, i) for i, _ in rows], "key long, id long"), candidates.keyed_rows)
    of = {i: np.array(sorted(x)) for i, x in rows}
    similar = spark.createDataFrame([(a, b) for a in of for b in of if a < b and line_dedup.jaccard(of[a], of[b]) >= 0.8], "a long, b long")
    verify = lambda pairs: candidates.stored(pairs.join(similar, ["a", "b"]))
    _, roots = candidates.settle(keys, candidates.paired(keys), verify, lambda ids: ids.join(elements, "id"), 0.8)
    assert {r.id: r.root for r in roots.collect()} == {2 * i + 1: 2 * i for i in range(120)}


def test_rows_for_a_large_bucket_are_linear_and_lose_no_link(spark, monkeypatch, tmp_path):
    """Twice the ids of an unsettled bucket are twice the rows that tasks read, and all links are found over parts and pieces."""
    for name, value in (("BLOCK", 16), ("PART", 40), ("PARTS", 3)):
        monkeypatch.setattr(candidates, name, value, raising=False)
    rng, log = random.Random(8), str(tmp_path / "rows")

    def seen(lists):
        with open(log, "a") as out:
            out.write(f"{len(lists)}\n")
        return candidates.elements_of(lists)

    for n, mains in ((160, 40), (320, 80), (320, 0), (90, 80)):
        rows = [(i, sorted(set(range(100)) - set(rng.sample(range(100), rng.choice((2, 8, 12)))) | set(rng.sample(range(1000, 9999), 5)))) for i in range(n)]
        rng.shuffle(rows)
        root = {i: 0 if i < mains else i for i, _ in rows}
        left = candidates.stored(spark.createDataFrame([(5, i, root[i], n) for i, _ in rows], "key long, id long, root long, n long"))
        bodies = candidates.stored(spark.createDataFrame(rows, "id long, body array<long>"))
        open(log, "w").close()
        found = [tuple(r) for r in candidates.within(left, bodies, 0.8, seen).collect()]
        sets = {i: np.array(x) for i, x in rows}
        close = [(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and line_dedup.jaccard(sets[a], sets[b]) >= 0.8]
        same = list(root.items())
        assert close and set(found) <= set(close)
        assert union_find(found + same) == union_find(close + same)
        once = max(mains, 1)  # the largest component
        assert sum(int(x) for x in open(log)) == once + 3 * (n - once)


def test_pieces_of_a_part_wait_in_a_file(monkeypatch):
    monkeypatch.setattr(candidates, "SPOOL", 1)
    held = candidates._Pieces(0, 1, 0.8, lambda x, y: x[0] == y[0])
    body = np.arange(10)
    rows = [(i, i, body if i < 4 else body + 99 * i, "ab"[i % 2]) for i in range(6)]
    for at in range(0, 6, 2):
        held.add(rows[at : at + 2], -1)
    assert sorted(held.links) == [(0, 2), (1, 3)]


def test_pipeline_stages_compare_large_buckets_whole(spark, monkeypatch):
    import corpus_pipeline

    asked, settle = [], candidates.settle
    monkeypatch.setattr(candidates, "settle", lambda *a: asked.append(a[5]) or settle(*a))
    docs = documents(spark, [(i, f"one line of text that all share\nand another number {i}") for i in range(4)])
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line dedup", "near duplicates"):
            assert stage(spark, docs, SF_DIR).count() == 4 or name == "near duplicates"
    assert asked == [True, True]

"""Golden rows and edge cases of operators that SQL does not cover."""

import gzip
import hashlib
import itertools
import lzma
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.oracle import difference
from weft.catalogue import oracles, queries
from weft.functions import expr
from weft.operators import metrics, projections, sampling, scalars, text, windows
from weft.sources import readers, sinks
from weft.streaming import operators as streaming


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_lcs_and_rouge(spark):
    a, b = F.array(*map(F.lit, "ABCBDAB")), F.array(*map(F.lit, "BDCABA"))
    assert one(spark, expr.lcs_length(a, b)) == 4
    assert one(spark, expr.lcs_length(a, F.array().cast("array<string>"))) == 0
    assert one(spark, metrics.rouge_l(a, a)) == 1.0


def test_subsequence_and_prefix(spark):
    arr = lambda s: F.array(*map(F.lit, s))
    assert one(spark, expr.is_subsequence(arr("ACE"), arr("ABCDE"))) is True
    assert one(spark, expr.is_subsequence(arr("CA"), arr("ABCDE"))) is False
    assert one(spark, expr.shared_prefix(arr("ABX"), arr("ABCD"))) == 2
    assert one(spark, expr.shared_prefix(arr("AB"), arr("ABCD"))) == 2


def test_set_f1_conventions(spark):
    empty = F.array().cast("array<string>")
    assert [one(spark, c) for c in expr.set_prf(empty, empty)] == [0.0] * 3
    assert [one(spark, c) for c in expr.set_prf(empty, empty, 1.0)] == [1.0] * 3
    dup = F.array(F.lit("a"), F.lit("a"), F.lit("b"))
    assert [round(one(spark, c), 3) for c in expr.set_prf(dup, F.array(F.lit("a")))] == [0.5, 1.0, 0.667]


def test_ordered_matching():
    assert metrics.align(["a", "b"], ["b", "a"], metrics.word_f1) in ([(0, 1)], [(1, 0)])
    assert metrics.align(["a", "b", "c"], ["a", "x", "b", "c"], metrics.word_f1) == [(0, 0), (1, 2), (2, 3)]
    assert metrics.align([], ["a"], metrics.word_f1) == []
    assert metrics.align(["a"], ["a", "a"], metrics.word_f1) == [(0, 0)]  # the earliest of equal partners
    assert metrics.align(["a", "a"], ["a"], metrics.word_f1) == [(0, 0)]
    assert metrics.align(["a", "a"], ["a", "a", "a"], metrics.word_f1) == [(0, 0), (1, 1)]
    assert metrics.align(["x", "a", "a", "a"], ["a", "y"], metrics.word_f1) == [(1, 0)]


def test_pass_at_k_ignores_zero(spark):
    zero = F.array(F.lit(0), F.lit(0))
    assert one(spark, metrics.pass_at_k(zero, zero, 2)) is False
    assert one(spark, F.array_join(metrics.merged_pools(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), "")) == "abc"


@pytest.mark.parametrize(
    ("raw", "stripped", "status"),
    [
        ("<think>x</think> y", "y", "closed_think"),
        ("<think>x", "", "malformed_think"),
        ("plain", "plain", "no_think"),
        ("<think>x</think>", "", "no_final"),
        ("</think>a<think>", "", "malformed_think"),
    ],
)
def test_reasoning(spark, raw, stripped, status):
    assert one(spark, text.reasoning_status(F.lit(raw))) == status
    if status != "malformed_think" or raw.startswith("<"):
        assert one(spark, text.strip_block(F.lit(raw))) == stripped


@pytest.mark.parametrize(
    ("said", "letters"),
    [("The answer is (B, A)", "AB"), ("Option C holds", "C"), ("x\n B. \ny", "B"), ("none", None), ("answer: D but option A", "D")],
)
def test_answers(spark, said, letters):
    assert one(spark, text.extract_letters(F.lit(said))) == letters


def test_strict_answers(spark):
    strict = lambda s: one(spark, text.strict_answer(F.lit(s)))
    assert strict("Answer: B\nso\nanswer is B") == "B"
    assert strict("Answer: B\nanswer is C") is None
    assert strict("the answer may be B\nanswer is B") is None
    assert strict("answer is B\nfine") is None


def test_json_spans():
    assert text.last_json('a [1] b [2, "]"] c [3') == '[2, "]"]'
    assert text.last_json("[1] </think> [2]") == "[2]"
    assert text.last_json('{"a": [1]} x', "{", "}") == '{"a": [1]}'
    assert text.last_json("none") is None
    assert text.last_json(None) is None


def test_flatten_and_paths():
    assert text.flatten_content([{"type": "text", "text": "a"}, "b", {"content": ["c"]}, None]) == "a\nb\nc"
    assert text.key_paths({"a": [{"b": 1}], "c": {"d": 2}}) == ["a", "a[].b", "c", "c.d"]


def test_option_runs(spark):
    lines = "A. x\nB. y\nC. z\nA. x\nB. y\nA) p\nB) q\nC) r\nD) s"
    assert one(spark, text.option_runs(F.lit(lines))) == ["ABC", "ABCD"]


def test_nfkc_and_literals(spark):
    df = spark.createDataFrame([("Ａ①​\r\n",), (None,)], "s string")
    assert [r[0] for r in df.select(text.nfkc("s")).collect()] == ["A1\n", None]
    df = spark.createDataFrame([("['a', \"b,c\"]",), ("['a'",), (None,)], "s string")
    assert [r[0] for r in df.select(text.literal_list("s")).collect()] == [["a", "b,c"], None, None]


def test_condition_language(spark):
    assert projections.condition_text(domain="goods", month="2024-01") == "domain is goods and month is 2024-01"
    with pytest.raises(ValueError, match="no such condition"):
        projections.condition("weather is fine")


def test_pack_round_trip(spark):
    df = spark.createDataFrame([(3, 1, 2, 8191), (0, 0, 0, 0), (1, 8192, 0, 0)], "d int, a int, b int, c int")
    packed = df.select(projections.pack(*map(F.col, "dabc")).alias("p"))
    rows = values(packed.select(*projections.unpack(F.col("p"))))
    assert rows[:2] == [(3, 1, 2, 8191), (0, 0, 0, 0)]
    assert rows[2] == (None,) * 4


def test_greedy_caps_is_greedy(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3]) for i in range(40)]
    got = [r.i for r in windows.greedy_caps(spark.createDataFrame(rows, "i int, s string, l string").repartition(5), ["i"], {"s": 4, "l": 3}, 7).collect()]
    used, want = {}, []
    for i, s, lang in rows:
        if len(want) < 7 and used.get(s, 0) < 4 and used.get(lang, 0) < 3:
            want.append(i)
            used[s], used[lang] = used.get(s, 0) + 1, used.get(lang, 0) + 1
    assert got == want


def test_exact_sum(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([7, 5, 3, 9, 4])], "k int, n long")
    assert sum(r.n for r in sampling.exact_sum_groups(sizes, "k", "n", "t", 12).collect()) == 12
    assert sampling.exact_sum_groups(sizes, "k", "n", "t", 2).collect() == []


def test_samples_do_not_depend_on_input_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = sorted(r.k for r in sampling.hash_sample(df, "s", "k", 20).collect())
    assert a == sorted(r.k for r in sampling.hash_sample(df.orderBy(F.desc("k")).repartition(7), "s", "k", 20).collect())


def test_clopper_pearson():
    assert math.isclose(scalars.cp_lower(20, 20), 0.05 ** (1 / 20), abs_tol=1e-9)
    assert scalars.cp_lower(0, 10) == 0.0
    assert scalars.minimum_trials(0.9) == 29


def test_json_lines_forms(spark):
    lines = spark.createDataFrame([('{"a":1}',), ('[{"a":2},{"a":3}]',), ("  ",)], "value string")
    assert sorted(values(readers.unwrap_json_lines(lines, "a int"))) == [(1,), (2,), (3,)]


def test_null_lists_have_no_rows(spark):
    from weft.operators.joins import zip_lists

    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, None, ["x"]), (3, [], [])], "k int, x array<int>, y array<string>")
    assert values(zip_lists(df, ["x", "y"], ["k"])) == [(1, 0, 1, "a"), (1, 1, 2, "b")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "a", 3)], "z int, a string, m int")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"a","m":3,"z":1}', '{"a":"b","m":null,"z":2}']
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json_lines(df, str(tmp_path / "j"))
    with pytest.raises(ValueError, match="protected"):
        sinks.write_new(df, str(tmp_path / "x" / "y"), protected=[str(tmp_path / "x")])
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 {i % 24:02d}:10:00", i % 3, "ab"[i % 2], float(i)) for i in range(60)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    batch = streaming.tumbling(rows, "6 hours")
    stream = streaming.tumbling(streaming.stream_of(spark, str(tmp_path / "in"), rows.schema), "6 hours", "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.sql("SELECT * FROM tumbled").collect())) == sorted(map(str, batch.collect()))


def test_state_counts_every_event(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 {i % 24:02d}:10:00", i % 3, "ab"[i % 2], float(i)) for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    q = streaming.running_totals(streaming.stream_of(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("update").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(values(spark.sql("SELECT user_id, max(n) FROM totals GROUP BY 1"))) == [(0, 10), (1, 10), (2, 10)]


def test_append_resumes(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "k")
    rows.write.parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for extra in (0, 1):
        if extra:
            spark.range(100, 110).withColumnRenamed("id", "k").write.mode("append").parquet(str(tmp_path / "in"))
        streaming.append_to(streaming.stream_of(spark, str(tmp_path / "in"), rows.schema, 100), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 30
    assert streaming.resume(spark.range(25).withColumnRenamed("id", "k"), spark.read.parquet(out), "k").count() == 5


def test_similar_pairs_read_every_part(spark, tmp_path):
    """Brute force over parts of any number, and on the given tables the SQL's rows where it has them."""
    rng = random.Random(23)
    names = [" ".join(rng.choice(("almond", "azure", "linen", "puff", "rose", "tomato")) for _ in range(3)) for _ in range(40)]
    rows = [(i * 37, rng.choice(names), rng.choice(("SMALL TIN", "LARGE TIN", "PROMO BRASS"))) for i in range(1, 90)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    first = {}
    for i, name, kind in rows:
        first.setdefault(f"{name} {kind.lower()}", i)
    for key, n, least in (("leak_near", 5, 0.5), ("near_dup", 3, 0.6)):
        sets = {i: {t[j : j + n] for j in range(len(t) - n + 1)} for t, i in first.items()}
        want = {(i, j): round(len(x & y) / len(x | y), 6) for i, x in sets.items() for j, y in sets.items() if i < j and len(x & y) / len(x | y) >= least}
        got = {(r.id, r.jd): r.sim for r in queries()[key](spark, str(tmp_path)).collect()}
        assert got == want
        assert any(i >= 300 for i, _ in want)
        whole = queries()[key](spark, "/root/testdata/sf0.01")
        assert difference(whole, oracles()[key], "/root/testdata/sf0.01") == ""
        assert whole.filter("jd >= 300").count() > 0


def test_a_missing_table_is_empty_with_a_reason(spark, tmp_path):
    df, reason = readers.probed(spark, str(tmp_path / "none.parquet"), "a long")
    assert (df.count(), df.columns, reason) == (0, ["a"], "path does not exist")
    df, reason = readers.probed(spark, "nowhere://x/y", "a long")
    assert df.count() == 0
    assert reason
    spark.range(3).write.parquet(str(tmp_path / "some"))
    df, reason = readers.probed(spark, str(tmp_path / "some"), "id long")
    assert (df.count(), reason) == (3, None)


def test_empty_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.parquet").write_bytes(b"")
    (tmp_path / "b.parquet").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    assert [f.rsplit("/", 1)[-1] for f in readers.non_empty_files(spark, str(tmp_path), "*.parquet")] == ["b.parquet"]


def test_csv_plain_and_zipped(spark, tmp_path):
    text = "\ufeffname,said\nann,\"one\ntwo, three\"\nbob,\n"
    (tmp_path / "x.csv").write_text(text, "utf-8")
    assert [(r["name"], r["said"]) for r in readers.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [("ann", "one\ntwo, three"), ("bob", None)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("dev/x.csv", text)
        archive.writestr("train/x.csv", text)
        archive.writestr("notes.txt", "no")
    rows = readers.read_zipped_csv(spark, str(tmp_path / "x.zip"), r"dev/.*\.csv").collect()
    assert [(r.member, r.row, r.fields) for r in rows] == [("dev/x.csv", 0, {"name": "ann", "said": "one\ntwo, three"}), ("dev/x.csv", 1, {"name": "bob", "said": ""})]


def test_restore_checks_what_it_reads(spark, tmp_path):
    data = b"one\ntwo\n"
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    (tmp_path / "y.xz").write_bytes(lzma.compress(data))
    want = (len(data), 2, hashlib.sha256(data).hexdigest())
    rows = readers.restored(spark, f"{tmp_path}/*.[gx]z", {"x.gz": want, "y.xz": want}).collect()
    assert sorted((r.file, r.row, r.value) for r in rows) == [(f, i, v) for f in ("x.gz", "y.xz") for i, v in enumerate(("one", "two"))]
    with pytest.raises(Exception, match="expected"):
        readers.restored(spark, f"{tmp_path}/x.gz", {"x.gz": (9, 2, want[2])}).collect()


def test_cached_tables_are_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(4)

    for _ in range(3):
        assert readers.cached(spark, str(tmp_path / "t"), build).count() == 4
    assert len(built) == 1


def test_injected_functions(spark):
    df = spark.createDataFrame([(1, ["ab", "c"], ["x", "ab", "C"])], "k int, g array<string>, p array<string>")
    same = lambda a, b: float(a.lower() == b.lower())
    assert [tuple(x) for x in df.select(metrics.matched_by(same)("g", "p").alias("m")).first().m] == [(0, 1), (1, 2)]
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 6.0), ("b", 1, 5.0), ("b", 9, 5.0)], "k string, v int, w double")
    rates = metrics.rate_by(rows, ["k"], lambda t: t["v"] == 1, lambda t: t["v"] < 5, "w")
    assert {r.k: r.rate for r in rates.collect()} == {"a": 0.25, "b": 1.0}
    assert {r.k: r.top for r in metrics.aggregate_by(rows, ["k"], ["v", "w"], lambda v, w: (v * w).max(), "top").collect()} == {"a": 2.0, "b": 45.0}


def test_chain_score_of_ties(spark):
    """Against the best of all order-preserving matchings, by enumeration."""
    rng = random.Random(5)
    for _ in range(60):
        gold, pred = ([rng.choice(("a b", "a c", "c", "d")) for _ in range(rng.randrange(0, 5))] for _ in range(2))
        pairs = metrics.align(gold, pred, metrics.word_f1)
        best = 0.0
        for k in range(min(len(gold), len(pred)) + 1):
            for left in itertools.combinations(range(len(gold)), k):
                for right in itertools.combinations(range(len(pred)), k):
                    best = max(best, sum(metrics.word_f1(gold[i], pred[j]) for i, j in zip(left, right, strict=True)))
        assert sum(metrics.word_f1(gold[i], pred[j]) for i, j in pairs) == pytest.approx(best)
        assert pairs == sorted(pairs)

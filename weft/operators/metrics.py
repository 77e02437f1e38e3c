"""Evaluation metrics, statistical comparison, leakage checks and selection contracts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weft.functions.expr import char_grams, hash_rank, hash_rank_sql, is_subsequence, lcs_length, r6, ratio, set_prf, shared_prefix
from weft.operators.joins import broadcast_if_small
from weft.operators.projections import TIMELINE, reasons, timeline
from weft.operators.scalars import cp_lower_column
from weft.operators.text import answer_text, extract_letters
from weft.operators.windows import average_rank, timeline_text
from weft.registry import query
from weft.sources.tables import table


def pass_at_k(candidates: Column, gold: Column, k: int) -> Column:
    """Whether one of the first k candidates is a gold id; id 0 never counts."""
    return F.arrays_overlap(F.filter(F.slice(candidates, 1, k), lambda x: x != 0), gold)


def merged_pools(first: Column, second: Column) -> Column:
    """Two candidate lists as one: first-seen order, no repeats."""
    return F.array_union(first, second)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two lists with repeats."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def token_f1(pred: Column, gold: Column) -> Column:
    shared = multiset_overlap(pred, gold)
    return ratio(2 * shared, F.size(pred) + F.size(gold))


def rouge_l(pred: Column, gold: Column) -> Column:
    """F-measure of the longest common subsequence of two token lists."""
    return ratio(2 * lcs_length(pred, gold), F.size(pred) + F.size(gold))


def align(gold: list[str], pred: list[str], similarity) -> list[tuple[int, int]]:
    """Order-preserving matching of greatest total similarity, for any similarity of two elements.

    Decided from the ends of both lists: a pair is taken only where it is strictly better than leaving out
    either element, and between equals the gold element is left out first.  So of equal partners the
    earliest is matched.
    """
    n, m = len(gold), len(pred)
    backward = [[similarity(g, p) for p in reversed(pred)] for g in reversed(gold)]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]  # of the lists up to the i-th and j-th element from the end
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + backward[i][j])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if best[i][j] > best[i + 1][j] and best[i][j] > best[i][j + 1]:
            out.append((n - 1 - i, m - 1 - j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out[::-1]


def word_f1(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    shared = sum(min(x.count(w), y.count(w)) for w in set(x))
    return 2 * shared / (len(x) + len(y)) if shared else 0.0


def matched_by(similarity: Callable[[str, str], float]):
    """Column function of two lists of texts: their order-preserving matching by any similarity of two texts."""

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("gold", T.IntegerType()), T.StructField("pred", T.IntegerType())])))
    def run(gold: pa.Array, pred: pa.Array) -> pa.Array:
        rows = [[{"gold": i, "pred": j} for i, j in align(g or [], p or [], similarity)] for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("gold", pa.int32()), ("pred", pa.int32())])))

    return run


ordered_match = matched_by(word_f1)


def rate_by(df: DataFrame, by: list[str], hit: Callable[[DataFrame], Column], eligible: Callable[[DataFrame], Column], weight: str) -> DataFrame:
    """Weighted rate of eligible rows, with what counts and what is eligible given as functions of the table."""
    rows = df.filter(eligible(df))
    return rows.groupBy(*by).agg(r6(ratio(F.sum(F.when(hit(df), F.col(weight)).otherwise(0)), F.sum(weight))).alias("rate"))


def aggregate_by(df: DataFrame, by: list[str], columns: list[str], fn: Callable[..., float], name: str) -> DataFrame:
    """Any function of a group's columns (as pandas series) as an aggregate; a group is held by one task."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> float:
        return float(fn(*series))

    return df.groupBy(*by).agg(run(*columns).alias(name))


@F.arrow_udf(T.DoubleType())
def chain_score(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """Mean of the matched share (F1 of summed similarities) and the matched pairs' mean similarity."""
    out = []
    for g, p in zip(gold.to_pylist(), pred.to_pylist(), strict=True):
        g, p = g or [], p or []
        pairs = align(g, p, word_f1)
        total = sum(word_f1(g[i], p[j]) for i, j in pairs)
        f1 = 2 * total / (len(g) + len(p)) if g or p else 0.0
        out.append(round((f1 + (total / len(pairs) if pairs else 0.0)) / 2, 6))
    return pa.array(out, pa.float64())


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns of a bounded set of items; null where one does not vary."""
    ranked = average_rank(average_rank(df, x, [], "_rx"), y, [], "_ry")
    return ranked.agg(r6(F.corr("_rx", "_ry")).alias("spearman"), r6(F.corr(x, y)).alias("pearson"))


def direction_agreement(df: DataFrame, item: str, x: str, y: str, band: float) -> DataFrame:
    """Share of pairs of a bounded set of items that two measures order alike; differences within the band are ties."""
    other = df.select(F.col(item).alias("_j"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    sign = lambda d: F.when(F.abs(d) <= band, 0).otherwise(F.signum(d).cast("int"))
    pairs = df.join(other, F.col(item) < F.col("_j")).select(sign(F.col(x) - F.col("_x")).alias("a"), sign(F.col(y) - F.col("_y")).alias("b"))
    return pairs.agg(F.count("*").alias("pairs"), r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("agree"))


def dedupe_conflicts(df: DataFrame, key: str, answer: str, row: str) -> DataFrame:
    """One row per key (the smallest row id) where all answers agree; keys with conflicting answers go."""
    per = df.groupBy(key).agg(F.min(answer).alias("_lo"), F.max(answer).alias("_hi"), F.min(row).alias(row), F.count("*").alias("n"))
    return per.filter(F.col("_lo") == F.col("_hi")).select(key, F.col("_lo").alias(answer), row, "n")


def part(spark, sf_dir):
    return table(spark, sf_dir, "part")


def orders_sets(spark, sf_dir):
    """Per order: the gold parts, and a prediction that is the parts of even lines and a shifted one."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", c.alias("v")))), lambda x: x["v"])
    return lines.groupBy("l_orderkey").agg(ordered(F.col("l_partkey") % 40).alias("gold"), ordered(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 40).otherwise(F.col("l_suppkey") % 40)).alias("pred"))


SETS = "SELECT l_orderkey, list(l_partkey % 40 ORDER BY l_linenumber, l_partkey) AS gold, list(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 40 ELSE l_suppkey % 40 END ORDER BY l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 40 ELSE l_suppkey % 40 END) AS pred FROM lineitem GROUP BY 1"


@query("pass_at_k", f"SELECT l_orderkey, len(list_filter(pred[:3], lambda x: x <> 0 AND x = gold[1])) > 0 AS hit FROM ({SETS})")
def pass_at_k_query(spark, sf_dir):
    return orders_sets(spark, sf_dir).select("l_orderkey", pass_at_k(F.col("pred"), F.array(F.col("gold")[0]), 3).alias("hit"))


@query("pass_at_k_merge", f"SELECT l_orderkey, list_has_any(list_filter(list_concat(pred[:2], pred[-2:]), lambda x: x <> 0), gold) AS hit FROM ({SETS})")
def pass_at_k_merge(spark, sf_dir):
    n = F.size("pred")
    pool = merged_pools(F.slice("pred", 1, 2), F.slice(F.col("pred"), F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return orders_sets(spark, sf_dir).select("l_orderkey", pass_at_k(pool, F.col("gold"), 4).alias("hit"))


_PRF = "SELECT l_orderkey, list_distinct({g}) AS g, list_distinct({p}) AS p FROM (" + SETS + ")"


def _prf_sql(g: str, p: str, empty: float) -> str:
    rate = lambda a, b: f"CASE WHEN len(g) = 0 AND len(p) = 0 THEN {empty} WHEN {b} = 0 THEN 0.0 ELSE round({a} / ({b}), 6) END"
    return f"SELECT l_orderkey, {rate('len(list_intersect(p, g))', 'len(p)')} AS precision, {rate('len(list_intersect(p, g))', 'len(g)')} AS recall, {rate('2 * len(list_intersect(p, g))', 'len(p) + len(g)')} AS f1 FROM ({_PRF.format(g=g, p=p)})"


@query("set_f1", _prf_sql("gold", "pred", 0.0))
def set_f1(spark, sf_dir):
    p, r, f = set_prf(F.col("pred"), F.col("gold"))
    return orders_sets(spark, sf_dir).select("l_orderkey", r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


@query("set_f1_empty1", _prf_sql("list_filter(gold, lambda x: x < 6)", "list_filter(pred, lambda x: x < 6)", 1.0))
def set_f1_empty1(spark, sf_dir):
    few = lambda c: F.filter(c, lambda x: x < 6)
    p, r, f = set_prf(few("pred"), few("gold"), 1.0)
    return orders_sets(spark, sf_dir).select("l_orderkey", r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


_SHARED = "list_sum([least(len(list_filter(pred, lambda y: y = x)), len(list_filter(gold, lambda y: y = x))) FOR x IN list_distinct(pred)])"


@query("token_f1", f"SELECT l_orderkey, round(2 * {_SHARED} / (len(pred) + len(gold)), 6) AS f1 FROM ({SETS})")
def token_f1_query(spark, sf_dir):
    return orders_sets(spark, sf_dir).select("l_orderkey", r6(token_f1(F.col("pred"), F.col("gold"))).alias("f1"))


@query("dice", f"SELECT l_orderkey, {_SHARED}::INTEGER AS shared, round(2 * {_SHARED} / (len(pred) + len(gold)), 6) AS dice FROM ({SETS})")
def dice(spark, sf_dir):
    shared = multiset_overlap(F.col("pred"), F.col("gold"))
    return orders_sets(spark, sf_dir).select("l_orderkey", shared.alias("shared"), r6(ratio(2 * shared, F.size("pred") + F.size("gold"))).alias("dice"))


#: Chains of equal places that rise in both lists; the longest is the longest common subsequence.
_LCS = f"""WITH RECURSIVE s AS ({SETS}), m AS (SELECT l_orderkey, i, j FROM s, unnest(range(1, len(gold) + 1)) g(i), unnest(range(1, len(pred) + 1)) p(j) WHERE gold[i] = pred[j]),
      c(l_orderkey, i, j, n) AS (SELECT l_orderkey, i, j, 1 FROM m UNION SELECT m.l_orderkey, m.i, m.j, c.n + 1 FROM c JOIN m ON m.l_orderkey = c.l_orderkey AND m.i > c.i AND m.j > c.j),
      l AS (SELECT s.l_orderkey, gold, pred, coalesce(max(n), 0)::INTEGER AS lcs FROM s LEFT JOIN c USING (l_orderkey) GROUP BY ALL) """


@query("lcs", _LCS + "SELECT l_orderkey, lcs FROM l")
def lcs(spark, sf_dir):
    return orders_sets(spark, sf_dir).select("l_orderkey", lcs_length(F.col("pred"), F.col("gold")).alias("lcs"))


@query("rouge_l", _LCS + "SELECT l_orderkey, round(2 * lcs / (len(pred) + len(gold)), 6) AS rouge_l FROM l")
def rouge_l_query(spark, sf_dir):
    return orders_sets(spark, sf_dir).select("l_orderkey", r6(rouge_l(F.col("pred"), F.col("gold"))).alias("rouge_l"))


def _chains(spark, sf_dir):
    """Gold and predicted chains of texts, per conversation."""
    turns = table(spark, sf_dir, "conversations")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", F.col("text").alias("w"))))), lambda x: x["w"])
    return turns.groupBy("conv_id").agg(listed(F.lit(True)).alias("gold"), listed(F.col("turn") % 3 != 1).alias("pred"))


@query("ordered_match")
def ordered_match_query(spark, sf_dir):
    return _chains(spark, sf_dir).select("conv_id", ordered_match("gold", "pred").alias("pairs"))


@query("chain_score")
def chain_score_query(spark, sf_dir):
    return _chains(spark, sf_dir).select("conv_id", chain_score("gold", "pred").alias("score"))


@query("topic_metric", _LCS + "SELECT l_orderkey, round((2 * lcs / (len(pred) + len(gold)) + len(list_intersect(list_distinct(gold), pred)) / len(list_distinct(gold))) / 2, 6) AS score FROM l")
def topic_metric(spark, sf_dir):
    """Older form: LCS over actions, and the share of gold topics named anywhere in the prediction."""
    sets = orders_sets(spark, sf_dir)
    action = rouge_l(F.col("pred"), F.col("gold"))
    topic = ratio(F.size(F.array_intersect("gold", "pred")), F.size(F.array_distinct("gold")))
    return sets.select("l_orderkey", r6((action + topic) / 2).alias("score"))


@query("mc_accuracy", "SELECT role, count(*) AS n, round(avg(CASE WHEN conv_id % 4 < 3 AND turn % 4 = conv_id % 4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM conversations GROUP BY 1")
def mc_accuracy(spark, sf_dir):
    """Share of rows whose extracted letters equal the gold ones; unparsable rows are wrong."""
    gold = F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    letters = extract_letters(F.when(F.col("conv_id") % 4 == 0, F.regexp_replace(answer_text(), ", a", "")).otherwise(answer_text()))
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), r6(F.avg(F.coalesce((letters == gold).cast("double"), F.lit(0.0)))).alias("accuracy"))


@query("response_score", f"SELECT l_orderkey, round(len(list_intersect(list_distinct(pred), gold)) / len(list_distinct(pred)), 6) AS quoted, (len(pred) - len(list_distinct(pred)))::INTEGER AS repeats FROM ({SETS})")
def response_score(spark, sf_dir):
    p, _, _ = set_prf(F.col("pred"), F.col("gold"))
    return orders_sets(spark, sf_dir).select("l_orderkey", r6(p).alias("quoted"), (F.size("pred") - F.size(F.array_distinct("pred"))).alias("repeats"))


@query(
    "hard_negative_pairs",
    f"""WITH c AS (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, {hash_rank_sql('hn', 'l_partkey', 'l_linenumber')}, l_partkey) AS r FROM lineitem WHERE l_returnflag <> 'N'), g AS (SELECT l_orderkey, min(l_partkey) AS chosen FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
        SELECT l_orderkey, chosen, l_partkey AS rejected FROM c JOIN g USING (l_orderkey) WHERE r <= 2""",
)
def hard_negative_pairs(spark, sf_dir):
    """For each prompt with a clean answer, its hardest unclean candidates."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_discount"), hash_rank("hn", "l_partkey", "l_linenumber"), "l_partkey")
    hard = lines.filter("l_returnflag <> 'N'").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    clean = lines.filter("l_returnflag = 'N'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("chosen"))
    return hard.join(clean, "l_orderkey").select("l_orderkey", "chosen", F.col("l_partkey").alias("rejected"))


_BRANDS = "SELECT p_brand, avg(p_retailprice) AS x, avg(p_size) AS y, count(*)::DOUBLE AS z FROM part GROUP BY 1"


def brands(spark, sf_dir):
    return part(spark, sf_dir).groupBy("p_brand").agg(F.avg("p_retailprice").alias("x"), F.avg("p_size").alias("y"), F.count("*").cast("double").alias("z"))


def _rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@query("spearman", f"WITH b AS ({_BRANDS}), r AS (SELECT x, y, {_rank_sql('x')} AS rx, {_rank_sql('y')} AS ry FROM b) SELECT round(corr(rx, ry), 6) + 0.0 AS spearman, round(corr(x, y), 6) + 0.0 AS pearson FROM r")
def spearman_query(spark, sf_dir):
    return spearman(brands(spark, sf_dir), "x", "y")


@query("direction_rate", f"WITH b AS ({_BRANDS}), p AS (SELECT CASE WHEN abs(a.x - c.x) <= 0.5 THEN 0 ELSE sign(a.x - c.x) END AS a, CASE WHEN abs(a.y - c.y) <= 0.5 THEN 0 ELSE sign(a.y - c.y) END AS b FROM b a JOIN b c ON a.p_brand < c.p_brand) SELECT count(*) AS pairs, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agree FROM p")
def direction_rate(spark, sf_dir):
    return direction_agreement(brands(spark, sf_dir), "p_brand", "x", "y", 0.5)


@query("mean_rank", f"WITH b AS ({_BRANDS}) SELECT p_brand, round((({_rank_sql('x')}) + ({_rank_sql('y')}) + ({_rank_sql('z')})) / 3, 6) AS mean_rank FROM b")
def mean_rank(spark, sf_dir):
    ranked = brands(spark, sf_dir)
    for c in "xyz":
        ranked = average_rank(ranked, c, [], f"r{c}")
    return ranked.select("p_brand", r6((F.col("rx") + F.col("ry") + F.col("rz")) / 3).alias("mean_rank"))


@query("verdict", f"WITH b AS ({_BRANDS}), r AS (SELECT {_rank_sql('x')} AS rx, {_rank_sql('z')} AS rz FROM b), c AS (SELECT abs(corr(rx, rz)) AS rho FROM r) SELECT CASE WHEN rho >= 0.8 THEN 'decidable' WHEN rho >= 0.4 THEN 'weak' ELSE 'undecidable' END AS verdict FROM c")
def verdict(spark, sf_dir):
    rho = F.abs(F.col("spearman"))
    return spearman(brands(spark, sf_dir), "x", "z").select(F.when(rho >= 0.8, "decidable").when(rho >= 0.4, "weak").otherwise("undecidable").alias("verdict"))


@query("ledger_audit")
def ledger_audit(spark, sf_dir):
    """Eligible decisions per class: coverage, accuracy, exact lower bound; repeated units count once."""
    rows = table(spark, sf_dir, "labels").withColumn("unit", F.col("doc_id") % 200).withColumn("decision", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise((F.col("doc_id") % 3 > 0).cast("int")))
    once = rows.groupBy("unit").agg(F.min_by(F.struct("decision", "quality"), "doc_id").alias("r"), F.count("*").alias("repeats")).select("unit", "r.*", "repeats")
    per = once.groupBy("quality").agg(F.count("*").alias("eligible"), F.count("decision").alias("decided"), F.coalesce(F.sum((F.col("decision") == F.col("quality")).cast("long")), F.lit(0)).alias("right"), F.sum(F.col("repeats") - 1).alias("repeated"))
    return per.withColumn("lower", cp_lower_column(F.col("right"), F.col("decided"))).withColumn("certified", F.col("lower") >= 0.8)


@query("gate_decision", f"WITH b AS ({_BRANDS}) SELECT p_brand, list_filter([CASE WHEN x < 905 THEN 'price' END, CASE WHEN y < 20 THEN 'size' END, CASE WHEN z < 4 THEN 'support' END], lambda r: r IS NOT NULL) AS reasons, x >= 905 AND y >= 20 AND z >= 4 AS passed FROM b")
def gate_decision(spark, sf_dir):
    found = reasons([("price", F.col("x") < 905), ("size", F.col("y") < 20), ("support", F.col("z") < 4)])
    return brands(spark, sf_dir).select("p_brand", found.alias("reasons"), (F.size(found) == 0).alias("passed"))


@query(
    "relevance_topk",
    f"""WITH s AS (SELECT e.user_id, e.event_id, round(0.6::DOUBLE * CASE WHEN p.p_brand = t.p_brand THEN 1.0::DOUBLE ELSE 0.0 END + 0.3::DOUBLE * CASE WHEN p.p_type = t.p_type THEN 1.0::DOUBLE ELSE 0.0 END + 0.1::DOUBLE * CASE WHEN e.domain = 'video' THEN 1.0::DOUBLE ELSE 0.0 END, 6) AS score
          FROM ({TIMELINE}) e JOIN part p ON p.p_partkey = e.item JOIN part t ON t.p_partkey = e.user_id) SELECT user_id, event_id, score FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id DESC) <= 3""",
)
def relevance_topk(spark, sf_dir):
    """Weighted relevance of history events to a target, above a threshold, the best of each user."""
    tags = part(spark, sf_dir).select(F.col("p_partkey").alias("item"), "p_brand", "p_type")
    targets = tags.select(F.col("item").alias("user_id"), F.col("p_brand").alias("tb"), F.col("p_type").alias("tt"))
    rows = timeline(spark, sf_dir).join(tags, "item").join(targets, "user_id")
    on = lambda c: c.cast("double")
    score = r6(0.6 * on(F.col("p_brand") == F.col("tb")) + 0.3 * on(F.col("p_type") == F.col("tt")) + 0.1 * on(F.col("domain") == "video"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("event_id"))
    return rows.select("user_id", "event_id", score.alias("score")).filter("score >= 0.3").withColumn("r", F.row_number().over(w)).filter("r <= 3").drop("r")


@query(
    "evidence_rank",
    """WITH d AS (SELECT DISTINCT doc_id, source, substr(text, i, 14) AS gram FROM documents, unnest(range(1, length(text) - 12)) t(i) WHERE length(text) >= 14),
       p AS (SELECT DISTINCT item_id, substr(text, i, 14) AS gram FROM benchmark, unnest(range(1, length(text) - 12)) t(i) WHERE length(text) >= 14),
       h AS (SELECT * FROM d JOIN p USING (gram)), r AS (SELECT gram, count(DISTINCT doc_id) AS df FROM h GROUP BY 1),
       s AS (SELECT item_id, doc_id, source, round(sum(1 / log2(df + 1)), 6) AS score FROM h JOIN r USING (gram) GROUP BY ALL),
       q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) <= 2)
       SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM q QUALIFY rank <= 5""",
)
def evidence_rank(spark, sf_dir):
    """History evidence for a probe by the inverse document frequency of shared n-grams, with quotas per source."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    grams = docs.select("doc_id", "source", F.explode(char_grams(F.col("text"), 14)).alias("gram"))
    probes = table(spark, sf_dir, "benchmark").select("item_id", F.explode(char_grams(F.col("text"), 14)).alias("gram"))
    hits = grams.join(broadcast_if_small(probes), "gram")
    rare = hits.select("gram", "doc_id").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    scored = hits.join(rare, "gram").groupBy("item_id", "doc_id", "source").agg(r6(F.sum(1 / F.log2(F.col("df") + 1))).alias("score"))
    per = scored.withColumn("q", F.row_number().over(Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id"))).filter("q <= 2")
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 5").drop("q")


@query("dedupe_conflict", "SELECT md5(text) AS k, min(quality) AS quality, min(doc_id) AS doc_id, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) = 1")
def dedupe_conflict(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", F.md5("text").alias("k")).join(table(spark, sf_dir, "labels"), "doc_id")
    return dedupe_conflicts(rows, "k", "quality", "doc_id")


_KEYS = {"raw": "{c}", "mode": "lower(trim({c}))", "core": r"regexp_replace(lower({c}), '[\s\p{P}\p{Z}\p{C}]', '', 'g')"}


def leak_keys(text: Column) -> Mapping[str, Column]:
    """Keys of rising tolerance under which two texts are the same."""
    return {"raw": text, "mode": F.lower(F.trim(text)), "core": F.regexp_replace(F.lower(text), r"[\s\p{P}\p{Z}\p{C}]", "")}


@query(
    "leak_exact",
    "WITH l AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line FROM documents) "
    + " UNION ALL ".join(f"SELECT '{n}' AS kind, doc_id, item_id FROM (SELECT DISTINCT doc_id, {k.format(c='line')} AS k FROM l) JOIN (SELECT item_id, {k.format(c='text')} AS k FROM benchmark) USING (k)" for n, k in ((n, k.replace("{P}", "{{P}}").replace("{Z}", "{{Z}}").replace("{C}", "{{C}}")) for n, k in _KEYS.items())),
)
def leak_exact(spark, sf_dir):
    """Lines that equal a benchmark item under one of the keys, by hash join."""
    lines = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    keyed = lambda df, row, c: df.select(row, F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.sha2(k, 256).alias("k")) for n, k in leak_keys(F.col(c)).items()])).alias("x")).select(row, "x.*").distinct()
    wanted = broadcast_if_small(keyed(items, "item_id", "text"))
    each = lines.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.sha2(k, 256).alias("k")) for n, k in leak_keys(F.col("line")).items()])).alias("x")).select("doc_id", "x.*")
    return each.join(wanted, ["kind", "k"]).select("kind", "doc_id", "item_id").distinct()  # only the lines that match are shuffled


_PN = "SELECT p_partkey, p_name || ' ' || lower(p_type) AS t FROM part"
_GRAMS = "list_distinct([substr(t, i, {n}) FOR i IN range(1, length(t) - {n} + 2)])"


def similar_pairs(rows: DataFrame, row: str, text: str, n: int, least: float) -> DataFrame:
    """Pairs of texts whose n-gram Jaccard similarity reaches ``least``.

    Prefix filter: sorted by rarity, two sets of that similarity share one of their first
    size - ceil(least * size) + 1 grams, so only those are joined; equal texts are one set.
    """
    sets = rows.select(row, text, char_grams(F.col(text), n).alias("grams")).groupBy(text, "grams").agg(F.collect_set(row).alias("rows"), F.min(row).alias("id"))
    grams = sets.select("id", F.explode("grams").alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = grams.join(rarity, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("o"))
    prefix = ordered.select("id", F.explode(F.slice(F.transform("o", lambda x: x["gram"]), F.lit(1), (F.size("o") - F.ceil(F.lit(least) * F.size("o")) + 1).cast("int"))).alias("gram"))
    pairs = prefix.join(prefix.select(F.col("id").alias("jd"), "gram"), "gram").filter("id < jd").select("id", "jd").distinct()
    a, b = sets.select("id", "grams", "rows"), sets.select(F.col("id").alias("jd"), F.col("grams").alias("hgrams"), F.col("rows").alias("srows"))
    similar = pairs.join(a, "id").join(b, "jd").withColumn("sim", ratio(F.size(F.array_intersect("grams", "hgrams")), F.size(F.array_union("grams", "hgrams"))))
    return similar.filter(F.col("sim") >= least).select("id", "jd", r6(F.col("sim")).alias("sim"))


def _sim_sql(n: int, least: float) -> str:
    return (
        f"WITH t AS ({_PN}), s AS (SELECT t, min(p_partkey) AS id, {_GRAMS.format(n=n)} AS g FROM t GROUP BY t), e AS (SELECT id, unnest(g) AS gram FROM s), "
        "c AS (SELECT a.id, b.id AS jd, count(*) AS n FROM e a JOIN e b USING (gram) WHERE a.id < b.id GROUP BY ALL) "
        "SELECT c.id, jd, round(n / (len(a.g) + len(b.g) - n), 6) AS sim FROM c JOIN s a ON a.id = c.id JOIN s b ON b.id = c.jd "
        f"WHERE n / (len(a.g) + len(b.g) - n) >= {least}"
    )


def _names(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("t"))


@query("leak_near", _sim_sql(5, 0.5))
def leak_near(spark, sf_dir):
    return similar_pairs(_names(spark, sf_dir), "p_partkey", "t", 5, 0.5)


@query("near_dup", _sim_sql(3, 0.6))
def near_dup(spark, sf_dir):
    return similar_pairs(_names(spark, sf_dir), "p_partkey", "t", 3, 0.6)


@query("adjudicate", f"WITH c AS (SELECT doc_id, md5(text) AS k FROM documents), a AS (SELECT doc_id, {hash_rank_sql('a', 'doc_id')} % 10 AS ca, quality AS qa FROM labels), b AS (SELECT doc_id, {hash_rank_sql('b', 'doc_id')} % 10 AS cb, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS qb FROM labels) SELECT k, min(doc_id) AS doc_id, min(qa) AS answer FROM c JOIN a USING (doc_id) JOIN b USING (doc_id) WHERE ca >= 2 AND cb >= 2 AND qa = qb GROUP BY 1")
def adjudicate(spark, sf_dir):
    """Rows on which two reviewers agree with enough confidence, one per meaning."""
    labels = table(spark, sf_dir, "labels")
    review = lambda n, q: labels.select("doc_id", (hash_rank(n, "doc_id") % 10).alias(f"c{n}"), q.alias(f"q{n}"))
    a, b = review("a", F.col("quality")), review("b", F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = table(spark, sf_dir, "documents", "doc_id", F.md5("text").alias("k")).join(a, "doc_id").join(b, "doc_id")
    return rows.filter("ca >= 2 AND cb >= 2 AND qa = qb").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.min("qa").alias("answer"))


@query("verify_extractive", f"SELECT user_id, true AS quoted, true AS ordered, true AS complete FROM ({TIMELINE}) GROUP BY 1")
def verify_extractive(spark, sf_dir):
    """Rendered timelines re-parsed: every quoted item exists, dates do not fall, line counts agree."""
    events = timeline(spark, sf_dir)
    text = timeline_text(events, "user_id")
    parsed = text.select("user_id", F.regexp_extract_all("text", F.lit(r"(?m)^- \w+ (\d+)$"), F.lit(1)).alias("items"), F.regexp_extract_all("text", F.lit(r"(?m)^# (\S+)$"), F.lit(1)).alias("days"))
    truth = events.groupBy("user_id").agg(F.collect_set(F.col("item").cast("string")).alias("known"), F.count("*").alias("n"))
    checked = parsed.join(truth, "user_id")
    return checked.select("user_id", (F.size(F.array_except("items", "known")) == 0).alias("quoted"), (F.col("days") == F.array_sort("days")).alias("ordered"), (F.size("items") == F.col("n")).alias("complete"))


@query(
    "mc_build",
    """WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority))[1:2] AS good FROM orders GROUP BY 1),
       o AS (SELECT *, list_concat(good, list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE'], lambda x: NOT list_contains(good, x))[1:1]) AS every FROM g),
       s AS (SELECT o_custkey, good, list_transform(list_sort(list_transform(every, lambda x: {'h': sha256(o_custkey::VARCHAR || x), 'o': x})), lambda x: x.o) AS options FROM o)
       SELECT o_custkey, options, array_to_string(list_transform(good, lambda x: substr('ABC', list_position(options, x), 1)), '') AS answer FROM s""",
)
def mc_build(spark, sf_dir):
    """Multiple choice from chains: supporting ones and a distractor, letters by hash order."""
    own = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    good = own.groupBy("o_custkey").agg(F.slice(F.array_sort(F.collect_set("o_orderpriority")), 1, 2).alias("good"))
    every = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")))
    options = F.concat("good", F.slice(F.array_except(every, "good"), 1, 1))
    ordered = F.transform(F.array_sort(F.transform(options, lambda o: F.struct(F.sha2(F.concat(F.col("o_custkey").cast("string"), o), 256).alias("h"), o.alias("o")))), lambda x: x["o"])
    return good.select("o_custkey", "good", ordered.alias("options")).select("o_custkey", "options", F.array_join(F.transform("good", lambda g: F.substring(F.lit("ABC"), F.array_position("options", g).cast("int"), F.lit(1))), "").alias("answer"))


@query(
    "bucket_select",
    f"""WITH b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1), one AS (SELECT p_name, min_by(p_partkey, ({hash_rank_sql('bs', 'p_partkey')}, p_partkey)) AS p_partkey FROM part GROUP BY 1), c AS (SELECT p_partkey, p_brand, n FROM one JOIN part USING (p_partkey) JOIN b USING (p_brand))
        SELECT p_partkey, p_brand, CASE WHEN {hash_rank_sql('bsv', 'p_partkey')} % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {hash_rank_sql('bs', 'p_partkey')}, p_partkey) <= CASE WHEN n >= 50 THEN 3 ELSE 2 END""",
)
def bucket_select(spark, sf_dir):
    """Captions made unique, then a quota per bucket that depends on its size, then disjoint splits."""
    parts = part(spark, sf_dir).select("p_partkey", "p_name", "p_brand")
    sizes = parts.groupBy("p_brand").agg(F.count("*").alias("n"))
    order = F.struct(hash_rank("bs", "p_partkey"), "p_partkey")
    one = parts.groupBy("p_name").agg(F.min_by(F.struct("p_partkey", "p_brand"), order).alias("b")).select("b.*").join(sizes, "p_brand")
    w = Window.partitionBy("p_brand").orderBy(hash_rank("bs", "p_partkey"), "p_partkey")
    kept = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("n") >= 50, 3).otherwise(2))
    return kept.select("p_partkey", "p_brand", F.when(hash_rank("bsv", "p_partkey") % 5 == 0, "val").otherwise("train").alias("split"))


@query(
    "bucket_keywords",
    """WITH w AS (SELECT p_brand, unnest(str_split(p_name, ' ')) AS word FROM part), c AS (SELECT p_brand, word, count(*) AS n FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, word) AS r FROM c) SELECT p_brand, string_agg(word, ' ' ORDER BY r) AS words FROM r WHERE r <= 3 GROUP BY 1""",
)
def bucket_keywords(spark, sf_dir):
    counts = part(spark, sf_dir).select("p_brand", F.explode(F.split("p_name", " ")).alias("word")).groupBy("p_brand", "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("n"), "word")
    top = counts.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("l"))
    return top.select("p_brand", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("words"))


@query("unique_owner", "SELECT p_name, min(p_brand) AS p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_owner(spark, sf_dir):
    return part(spark, sf_dir).groupBy("p_name").agg(F.min("p_brand").alias("p_brand"), F.max("p_brand").alias("hi")).filter("p_brand = hi").drop("hi")


@query(
    "mix_contract",
    f"""WITH u AS (SELECT 'doc' AS route, doc_id AS id, md5(text) AS k FROM documents UNION ALL SELECT 'turn', conv_id * 1000 + turn, md5(text) FROM conversations) SELECT route, count(*) AS n, count(DISTINCT k) AS prompts, sum(CASE WHEN e > 2 THEN 1 ELSE 0 END)::BIGINT AS over_exposed, min({hash_rank_sql('mix', 'id')}) AS first_rank FROM (SELECT *, count(*) OVER (PARTITION BY k) AS e FROM u) GROUP BY 1""",
)
def mix_contract(spark, sf_dir):
    """Routes of a mixture: rows, prompts, rows over the exposure limit, first hash rank."""
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("route"), F.col("doc_id").alias("id"), F.md5("text").alias("k"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("route"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.md5("text").alias("k"))
    rows = docs.unionByName(turns).withColumn("rank", hash_rank("mix", "id"))
    keys = rows.groupBy("k").agg(F.count("*").alias("e"))
    per = rows.groupBy("route", "k").agg(F.count("*").alias("n"), F.min("rank").alias("rank")).join(keys, "k")
    return per.groupBy("route").agg(F.sum("n").alias("n"), F.count("*").alias("prompts"), F.coalesce(F.sum(F.when(F.col("e") > 2, F.col("n"))), F.lit(0)).alias("over_exposed"), F.min("rank").alias("first_rank"))


@query("grounded", f"SELECT l_orderkey, len(list_filter(pred, lambda x: NOT list_contains(gold, x))) = 0 AS grounded FROM ({SETS})")
def grounded(spark, sf_dir):
    return orders_sets(spark, sf_dir).select("l_orderkey", (F.size(F.array_except("pred", "gold")) == 0).alias("grounded"))


@query("first_miss_class", "SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'a' WHEN p_partkey % 3 > 0 THEN 'b' WHEN p_retailprice > 905 THEN 'c' ELSE 'full' END AS miss FROM part")
def first_miss_class(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", F.when(F.col("p_size") % 2 == 1, "a").when(F.col("p_partkey") % 3 > 0, "b").when(F.col("p_retailprice") > 905, "c").otherwise("full").alias("miss"))


@query(
    "prefix_coverage",
    f"""WITH s AS ({SETS}), d AS (SELECT l_orderkey, unnest([1, 2, 3]) AS depth, gold, pred FROM s) SELECT depth, count(*) FILTER (WHERE len(gold) >= depth) AS golds, count(*) FILTER (WHERE len(gold) >= depth AND len(pred) >= depth AND gold[:depth] = pred[:depth]) AS covered, sum(CASE WHEN len(gold) >= depth AND len(pred) >= depth AND gold[:depth] = pred[:depth] THEN depth ELSE 0 END)::BIGINT AS mass FROM d GROUP BY 1""",
)
def prefix_coverage(spark, sf_dir):
    shared = orders_sets(spark, sf_dir).select(F.size("gold").alias("n"), shared_prefix(F.col("pred"), F.col("gold")).alias("s"))
    deep = shared.select("n", "s", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("depth"))
    hit = F.col("s") >= F.col("depth")
    return deep.groupBy("depth").agg(F.count(F.when(F.col("n") >= F.col("depth"), 1)).alias("golds"), F.count(F.when(hit, 1)).alias("covered"), F.sum(F.when(hit, F.col("depth")).otherwise(0)).cast("long").alias("mass"))


@query("group_hit_rate", "WITH top AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 3) SELECT p_brand, round(avg(CASE WHEN p_type IN (SELECT * FROM top) THEN 1.0 ELSE 0.0 END), 6) AS rate FROM part GROUP BY 1 HAVING avg(CASE WHEN p_type IN (SELECT * FROM top) THEN 1.0 ELSE 0.0 END) >= 0.5")
def group_hit_rate(spark, sf_dir):
    parts = part(spark, sf_dir).select("p_brand", "p_type")
    top = parts.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(3).select("p_type", F.lit(1.0).alias("hit"))
    rates = parts.join(F.broadcast(top), "p_type", "left").groupBy("p_brand").agg(r6(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("rate"))  # top: three rows
    return rates.filter("rate >= 0.5")


@query("reason_consistent", "SELECT conv_id, turn, turn % 2 = 0 AS consistent FROM conversations")
def reason_consistent(spark, sf_dir):
    """The last letter asserted in the reasoning must be the final one."""
    final = F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    other = F.substring(F.lit("BCDA"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    reasoning = F.concat(F.lit("answer is "), other, F.lit(" or answer is "), F.when(F.col("turn") % 2 == 0, final).otherwise(other))
    said = F.element_at(F.regexp_extract_all(reasoning, F.lit("answer is ([A-D])"), F.lit(1)), -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (said == final).alias("consistent"))


def quoted_in_order(pred: Column, history: Column) -> Column:
    return is_subsequence(pred, history)


def summarise(scores: pd.Series) -> dict[str, float]:
    """A bounded set of scores as mean, median and extremes, for reports."""
    return {"mean": float(scores.mean()), "median": float(scores.median()), "min": float(scores.min()), "max": float(scores.max())}

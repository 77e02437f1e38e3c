"""Aggregations: counts, quantile families, entropy, coverage, collisions, funnels.

Whole-table statistics over rows (percentiles, running shares) first reduce to one row per distinct value
or key, so that a window over the whole result covers the distinct values only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from weft.functions.expr import hash_rank, hash_rank_sql, r6, ratio
from weft.operators.projections import TIMELINE, document_reasons, timeline
from weft.registry import query
from weft.sources.tables import table


def whole() -> WindowSpec:
    """A window over all rows: for results that hold one row per distinct value only."""
    return Window.partitionBy()


def entropy(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Base-2 entropy of the counts of each group: log2 N - sum(n log2 n) / N."""
    total = F.sum(n)
    return counts.groupBy(*by).agg((F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total).alias("h"), total.alias("total"))


def conditional_entropy(df: DataFrame, x: list[str], y: list[str]) -> DataFrame:
    """H(Y), H(Y|X) and the information gain, from one grouping by (X, Y)."""
    base = df.groupBy(*dict.fromkeys([*x, *y])).agg(F.count("*").alias("n"))
    given = entropy(base, x).agg((F.sum(F.col("h") * F.col("total")) / F.sum("total")).alias("h_y_given_x"))
    plain = entropy(base.groupBy(*y).agg(F.sum("n").alias("n")), []).select(F.col("h").alias("h_y"))
    gain = F.col("h_y") - F.col("h_y_given_x")
    return plain.crossJoin(given).select(r6(F.col("h_y")).alias("h_y"), r6(F.col("h_y_given_x")).alias("h_y_given_x"), r6(gain).alias("gain"), r6(ratio(100 * gain, F.col("h_y"))).alias("gain_pct"))  # one row each


def running(df: DataFrame, order: list[Column], n: str = "n") -> DataFrame:
    """Adds ``rank``, ``upto`` and ``share`` (running count over the total) to one row per distinct key."""
    w = whole().orderBy(*order)
    total = F.sum(n).over(whole())
    return df.withColumn("rank", F.row_number().over(w)).withColumn("upto", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("share", F.col("upto") / total).withColumn("total", total)


def quantile_at(counts: DataFrame, value: str, index: Column, name: str) -> DataFrame:
    """The value at a 0-based place of the sorted rows, from counts per distinct value."""
    held = running(counts, [F.col(value)])
    return held.filter((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)).agg(F.min(value).alias(name))


def weighted_quantile(df: DataFrame, value: str, weight: str, q: float, name: str) -> DataFrame:
    """The smallest value whose cumulative weight reaches q of all."""
    held = running(df.groupBy(value).agg(F.sum(weight).alias("n")), [F.col(value)])
    return held.filter(F.col("upto") >= q * F.col("total")).agg(F.min(value).alias(name))


def duplicate_summary(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Rows, distinct keys, rows in duplicate groups, such groups and the largest."""
    n = F.col("n")
    per = df.groupBy(*by, key).agg(F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("duplicate_rows"), F.count(F.when(n > 1, 1)).alias("duplicate_groups"), F.max("n").alias("max_group"))


def part(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "part", *columns)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *columns)


@query("group_count", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_count(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("grouping_sets", "SELECT p_type, p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type, p_brand, p_size), (p_type, p_brand), (p_type), ())")
def grouping_sets(spark, sf_dir):
    """Counts at every level from one base cube, re-aggregated."""
    return part(spark, sf_dir, "p_type", "p_brand", "p_size").rollup("p_type", "p_brand", "p_size").agg(F.count("*").alias("n"))


@query(
    "vocab_summary",
    """SELECT p_type, level, count(DISTINCT code) AS n_unique, min(code) AS min_code, max(code) AS max_code, count(*) AS total
       FROM (SELECT p_type, unnest(['a', 'b', 'c']) AS level, unnest([regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER, p_size, (p_partkey % 8)::INTEGER]) AS code FROM part) GROUP BY ALL""",
)
def vocab_summary(spark, sf_dir):
    codes = part(spark, sf_dir).select("p_type", F.expr("stack(3, 'a', int(regexp_extract(p_brand, '([0-9]+)', 1)), 'b', p_size, 'c', int(p_partkey % 8)) AS (level, code)"))
    return codes.groupBy("p_type", "level").agg(F.countDistinct("code").alias("n_unique"), F.min("code").alias("min_code"), F.max("code").alias("max_code"), F.count("*").alias("total"))


@query("branch_factor", "SELECT p_type, count(*) AS parents, round(avg(n), 6) AS mean_children, round(quantile_cont(n, 0.9), 6) AS p90_children FROM (SELECT p_type, p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY ALL) GROUP BY 1")
def branch_factor(spark, sf_dir):
    children = part(spark, sf_dir).groupBy("p_type", "p_brand").agg(F.countDistinct("p_size").alias("n"))
    return children.groupBy("p_type").agg(F.count("*").alias("parents"), F.round(F.avg("n"), 6).alias("mean_children"), F.round(F.percentile("n", 0.9), 6).alias("p90_children"))


@query("percentiles", "SELECT lang, floor(quantile_cont(n_chars, 0.5))::BIGINT AS p50, floor(quantile_cont(n_chars, 0.9))::BIGINT AS p90, floor(quantile_cont(n_chars, 0.99))::BIGINT AS p99 FROM documents GROUP BY 1")
def percentiles(spark, sf_dir):
    q = lambda p: F.floor(F.percentile("n_chars", p)).alias(f"p{round(100 * p)}")
    return documents(spark, sf_dir, "lang", "n_chars").groupBy("lang").agg(q(0.5), q(0.9), q(0.99))


@query("percentile_disc", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def percentile_disc(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "value")
    return events.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"))


@query(
    "percentile_nearest",
    "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT (SELECT n_chars FROM s WHERE i = round_even((n - 1) * 0.5, 0)) AS p50, (SELECT n_chars FROM s WHERE i = round_even((n - 1) * 0.95, 0)) AS p95",
)
def percentile_nearest(spark, sf_dir):
    counts = documents(spark, sf_dir, "n_chars").groupBy("n_chars").agg(F.count("*").alias("n"))
    at = lambda q, name: quantile_at(counts, "n_chars", F.bround((F.col("total") - 1) * q, 0), name)
    return at(0.5, "p50").crossJoin(at(0.95, "p95"))  # one row each


@query("weighted_quantile", "WITH v AS (SELECT l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS t FROM v) SELECT min(v) FILTER (WHERE c >= 0.9 * t) AS q90 FROM c")
def weighted_quantile_query(spark, sf_dir):
    return weighted_quantile(table(spark, sf_dir, "lineitem", "l_quantity", "l_linenumber"), "l_quantity", "l_linenumber", 0.9, "q90")


@query("weighted_rate", "SELECT l_returnflag, round(sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS rate FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def weighted_rate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_quantity", "l_linestatus").filter("l_linestatus = 'F'")
    return lines.groupBy("l_returnflag").agg(r6(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)) / F.sum("l_quantity")).alias("rate"))


@query(
    "strat_estimate",
    f"""WITH s AS (SELECT source, count(*) AS exact FROM documents GROUP BY 1), x AS (SELECT source, n_chars FROM documents WHERE {hash_rank_sql('strat', 'doc_id')} % 4 = 0),
        m AS (SELECT source, count(*) AS sampled, sum(n_chars) AS chars FROM x GROUP BY 1)
        SELECT sum(sampled)::BIGINT AS sampled, round(sum(exact::DOUBLE / sampled * chars) / sum(exact), 6) AS mean_chars FROM s JOIN m USING (source)""",
)
def strat_estimate(spark, sf_dir):
    """A mean from a sample, each stratum weighted by its exact rows over its sampled ones."""
    docs = documents(spark, sf_dir, "doc_id", "source", "n_chars").withColumn("picked", hash_rank("strat", "doc_id") % 4 == 0)
    per = docs.groupBy("source").agg(F.count("*").alias("exact"), F.count(F.when(F.col("picked"), 1)).alias("sampled"), F.sum(F.when(F.col("picked"), F.col("n_chars"))).alias("chars")).filter("sampled > 0")
    return per.agg(F.sum("sampled").alias("sampled"), r6(F.sum(F.col("exact") / F.col("sampled") * F.col("chars")) / F.sum("exact")).alias("mean_chars"))


@query("entropy", "SELECT p_type, round(entropy(p_brand), 6) + 0.0 AS h FROM part GROUP BY 1")
def entropy_query(spark, sf_dir):
    counts = part(spark, sf_dir).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return entropy(counts, ["p_type"]).select("p_type", r6(F.col("h")).alias("h"))


@query(
    "cond_entropy",
    """WITH x AS (SELECT p_type, entropy(p_brand) AS h, count(*) AS n FROM part GROUP BY 1), y AS (SELECT entropy(p_brand) AS h FROM part), g AS (SELECT sum(h * n) / sum(n) AS hx FROM x)
       SELECT round(h, 6) + 0.0 AS h_y, round(hx, 6) + 0.0 AS h_y_given_x, round(h - hx, 6) + 0.0 AS gain, round(100 * (h - hx) / h, 6) + 0.0 AS gain_pct FROM y, g""",
)
def cond_entropy(spark, sf_dir):
    return conditional_entropy(part(spark, sf_dir, "p_type", "p_brand"), ["p_type"], ["p_brand"])


@query(
    "head_tail_share",
    """WITH c AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_name) AS rk, sum(n) OVER (ORDER BY n DESC, p_name ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER () AS t, count(*) OVER () AS k FROM c)
       SELECT round(sum(n) FILTER (WHERE rk <= ceil(0.1 * k)) / any_value(t), 6) AS top_tenth, count(*) FILTER (WHERE n < 5) AS rare, min(rk) FILTER (WHERE upto >= 0.5 * t) AS to_half FROM r""",
)
def head_tail_share(spark, sf_dir):
    counts = part(spark, sf_dir, "p_name").groupBy("p_name").agg(F.count("*").alias("n"))
    held = running(counts, [F.desc("n"), F.col("p_name")]).withColumn("k", F.count("*").over(whole()))
    top = F.sum(F.when(F.col("rank") <= F.ceil(F.lit(0.1) * F.col("k")), F.col("n"))) / F.max("total")
    return held.agg(r6(top).alias("top_tenth"), F.count(F.when(F.col("n") < 5, 1)).alias("rare"), F.min(F.when(F.col("upto") >= 0.5 * F.col("total"), F.col("rank"))).cast("long").alias("to_half"))


@query(
    "collision_stats",
    """WITH k AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT count(*) FILTER (WHERE n > 1) AS shared_keys, round(100.0 * coalesce(sum(n) FILTER (WHERE n > 1), 0) / sum(n), 6) AS shared_rows_pct, max(n) AS max_n, round(avg(n), 6) AS avg_n FROM k""",
)
def collision_stats(spark, sf_dir):
    n, keys = F.col("n"), part(spark, sf_dir, "p_name").groupBy("p_name").agg(F.count("*").alias("n"))
    return keys.agg(F.count(F.when(n > 1, 1)).alias("shared_keys"), r6(100.0 * F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)) / F.sum(n)).alias("shared_rows_pct"), F.max(n).alias("max_n"), F.round(F.avg(n), 6).alias("avg_n"))


@query("overlap_matrix", "WITH k AS (SELECT DISTINCT p_name, p_type FROM part) SELECT a.p_type AS d1, b.p_type AS d2, count(*) AS shared FROM k a JOIN k b USING (p_name) GROUP BY ALL")
def overlap_matrix(spark, sf_dir):
    """Keys that two categories share; a key's categories are a small set, paired inside its row."""
    sets = part(spark, sf_dir).groupBy("p_name").agg(F.collect_set("p_type").alias("types"))
    return sets.select(F.explode("types").alias("d1"), "types").select("d1", F.explode("types").alias("d2")).groupBy("d1", "d2").agg(F.count("*").alias("shared"))


_VENN = "SELECT doc_id, 1 AS s, 0 AS c, 0 AS t FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT page_id, 0, 0, 1 FROM pages"


@query("venn3", f"WITH k AS (SELECT doc_id, max(s) AS s, max(c) AS c, max(t) AS t FROM ({_VENN}) GROUP BY 1) SELECT s, c, t, count(*) AS n FROM k GROUP BY ALL")
def venn3(spark, sf_dir):
    """The regions of three key sets, by one grouping of their union."""
    flagged = lambda df, key, at: df.select(F.col(key).alias("k"), *[F.lit(int(i == at)).alias(n) for i, n in enumerate("sct")])
    union = flagged(documents(spark, sf_dir), "doc_id", 0).unionByName(flagged(table(spark, sf_dir, "labels"), "doc_id", 1)).unionByName(flagged(table(spark, sf_dir, "pages"), "page_id", 2))
    keys = union.groupBy("k").agg(*[F.max(n).alias(n) for n in "sct"])
    return keys.groupBy("s", "c", "t").agg(F.count("*").alias("n"))


_MASK = f"SELECT user_id, max(CASE WHEN domain = 'video' AND value > 60 THEN 1 ELSE 0 END) + max(CASE WHEN domain = 'ad' AND value > 60 THEN 2 ELSE 0 END) + max(CASE WHEN domain = 'goods' AND value > 60 THEN 4 ELSE 0 END) + max(CASE WHEN domain = 'live' AND value > 60 THEN 8 ELSE 0 END) AS mask FROM ({TIMELINE}) GROUP BY 1"
DOMAINS = ("video", "ad", "goods", "live")


def activity_mask(events: DataFrame, active: Column) -> DataFrame:
    """One bit per domain in which a user is active."""
    bits = [F.max(F.when((F.col("domain") == d) & active, 1 << i).otherwise(0)) for i, d in enumerate(DOMAINS)]
    return events.groupBy("user_id").agg((bits[0] + bits[1] + bits[2] + bits[3]).alias("mask"))


@query("bitmask_combo", f"SELECT mask, array_to_string(list_filter([CASE WHEN mask & 1 > 0 THEN 'video' END, CASE WHEN mask & 2 > 0 THEN 'ad' END, CASE WHEN mask & 4 > 0 THEN 'goods' END, CASE WHEN mask & 8 > 0 THEN 'live' END], lambda x: x IS NOT NULL), '+') AS names, count(*) AS users FROM ({_MASK}) GROUP BY ALL")
def bitmask_combo(spark, sf_dir):
    masks = activity_mask(timeline(spark, sf_dir), F.col("value") > 60)
    names = F.concat_ws("+", *[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(d)) for i, d in enumerate(DOMAINS)])
    return masks.groupBy("mask", names.alias("names")).agg(F.count("*").alias("users"))


@query("k_active_hist", f"SELECT k, count(mask) AS users FROM (SELECT unnest(range(5)) AS k) s LEFT JOIN ({_MASK}) m ON bit_count(mask) = k GROUP BY 1")
def k_active_hist(spark, sf_dir):
    masks = activity_mask(timeline(spark, sf_dir), F.col("value") > 60).groupBy(F.bit_count("mask").cast("long").alias("k")).agg(F.count("*").alias("users"))
    return spark.range(5).withColumnRenamed("id", "k").join(masks, "k", "left").select("k", F.coalesce("users", F.lit(0)).alias("users"))


@query(
    "tertile_strata",
    """WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), q AS (SELECT quantile_cont(n, 0.3333) AS lo, quantile_cont(n, 0.6667) AS hi FROM u)
       SELECT CASE WHEN n <= lo THEN 'low' WHEN n > hi THEN 'high' ELSE 'mid' END AS layer, count(*) AS users, sum(n)::BIGINT AS events FROM u, q GROUP BY 1""",
)
def tertile_strata(spark, sf_dir):
    users = table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))
    cuts = users.agg(F.percentile("n", 0.3333).alias("lo"), F.percentile("n", 0.6667).alias("hi"))
    layer = F.when(F.col("n") <= F.col("lo"), "low").when(F.col("n") > F.col("hi"), "high").otherwise("mid")
    return users.crossJoin(F.broadcast(cuts)).groupBy(layer.alias("layer")).agg(F.count("*").alias("users"), F.sum("n").alias("events"))  # cuts: one row


@query("crosstab", "SELECT lang, count(*) FILTER (WHERE quality = 0) AS q0, count(*) FILTER (WHERE quality = 1) AS q1, count(*) AS total FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def crosstab(spark, sf_dir):
    both = documents(spark, sf_dir, "doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = both.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return counts.select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"), (F.col("0") + F.col("1")).alias("total"))


@query("label_rate", f"SELECT action, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0.0 END), 6) AS above, round(avg(CASE WHEN item = 1 THEN 1.0 ELSE 0.0 END), 6) AS is_one FROM ({TIMELINE}) GROUP BY 1")
def label_rate(spark, sf_dir):
    lists = timeline(spark, sf_dir).groupBy("user_id", "action").agg(F.collect_list(F.struct("value", "item")).alias("l"))
    each = lists.select("action", F.explode("l").alias("x"))
    return each.groupBy("action").agg(F.round(F.avg((F.col("x.value") > 20).cast("double")), 6).alias("above"), F.round(F.avg((F.col("x.item") == 1).cast("double")), 6).alias("is_one"))


@query("value_dist_others", "WITH c AS (SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY p_size) AS r FROM part GROUP BY 1) SELECT CASE WHEN r <= 6 THEN p_size::VARCHAR ELSE 'others' END AS val, sum(n)::BIGINT AS n FROM c GROUP BY 1")
def value_dist_others(spark, sf_dir):
    counts = running(part(spark, sf_dir, "p_size").groupBy("p_size").agg(F.count("*").alias("n")), [F.col("p_size")])
    return counts.groupBy(F.when(F.col("rank") <= 6, F.col("p_size").cast("string")).otherwise("others").alias("val")).agg(F.sum("n").alias("n"))


@query("nonzero_pct", "SELECT round(100.0 * count(*) FILTER (WHERE l_discount = 0) / count(*), 6) AS zero_pct, round(quantile_cont(l_discount, 0.5) FILTER (WHERE l_discount > 0), 6) AS p50, round(quantile_cont(l_discount, 0.9) FILTER (WHERE l_discount > 0), 6) AS p90 FROM lineitem")
def nonzero_pct(spark, sf_dir):
    positive = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem", "l_discount").agg(r6(100.0 * F.count(F.when(F.col("l_discount") == 0, 1)) / F.count("*")).alias("zero_pct"), r6(F.percentile(positive, 0.5)).alias("p50"), r6(F.percentile(positive, 0.9)).alias("p90"))


@query("topk_share", "SELECT p_name, n, round(n / t, 6) AS share FROM (SELECT p_name, count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY 1) ORDER BY n DESC, p_name LIMIT 10")
def topk_share(spark, sf_dir):
    counts = part(spark, sf_dir, "p_name").groupBy("p_name").agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", r6(F.col("n") / F.sum("n").over(whole())))
    return shared.orderBy(F.desc("n"), "p_name").limit(10)


@query(
    "group_top3_share",
    """WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rk, sum(n) OVER (PARTITION BY p_type) AS t, sum(n) OVER (PARTITION BY p_type ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING) AS upto FROM c WINDOW w AS (PARTITION BY p_type ORDER BY n DESC, p_brand))
       SELECT p_type, p_brand, rk::INTEGER AS rank, round(n / t, 6) AS share, round(upto / t, 6) AS cumulative FROM r WHERE rk <= 3 AND t >= 20""",
)
def group_top3_share(spark, sf_dir):
    counts = part(spark, sf_dir).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")
    total = F.sum("n").over(Window.partitionBy("p_type"))
    ranked = counts.select("p_type", "p_brand", F.row_number().over(w).alias("rank"), r6(F.col("n") / total).alias("share"), r6(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("cumulative"), total.alias("t"))
    return ranked.filter("rank <= 3 AND t >= 20").drop("t")


@query(
    "dup_summary",
    """WITH k AS (SELECT source, md5(text) AS h, count(*) AS n FROM documents GROUP BY ALL) SELECT source, sum(n)::BIGINT AS n_rows, count(*) AS n_unique, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups, max(n) AS max_group FROM k GROUP BY 1""",
)
def dup_summary(spark, sf_dir):
    return duplicate_summary(documents(spark, sf_dir, "source", F.md5("text").alias("h")), "h", ["source"])


@query(
    "cross_overlap",
    """WITH a AS (SELECT text, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT text, count(*) AS n FROM conversations GROUP BY 1) SELECT count(*) AS common, coalesce(sum(a.n), 0)::BIGINT AS left_rows, coalesce(sum(b.n), 0)::BIGINT AS right_rows FROM a JOIN b USING (text)""",
)
def cross_overlap(spark, sf_dir):
    hashed = lambda name, n: table(spark, sf_dir, name, F.sha2("text", 256).alias("h")).groupBy("h").agg(F.count("*").alias(n))
    both = hashed("documents", "l").join(hashed("conversations", "r"), "h")
    return both.agg(F.count("*").alias("common"), F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"))


@query("numeric_summary", "SELECT round(avg(n_chars), 6) AS mean, quantile_cont(n_chars, 0.5) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, max(n_chars) AS max, count(*) FILTER (WHERE n_chars > 1000) AS over_1000, count(*) FILTER (WHERE n_chars > 5000) AS over_5000 FROM documents")
def numeric_summary(spark, sf_dir):
    n = F.col("n_chars")
    return documents(spark, sf_dir, "n_chars").agg(F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.5).alias("p50"), F.round(F.percentile(n, 0.9), 6).alias("p90"), F.max(n).alias("max"), F.count(F.when(n > 1000, 1)).alias("over_1000"), F.count(F.when(n > 5000, 1)).alias("over_5000"))


@query("median_summary", "SELECT l_returnflag, round(avg(l_tax - l_discount), 6) + 0.0 AS mean, round(median(l_tax - l_discount), 6) + 0.0 AS median, round(min(l_tax - l_discount), 6) + 0.0 AS min, round(max(l_tax - l_discount), 6) + 0.0 AS max, round(avg(CASE WHEN l_tax > l_discount THEN 1.0 ELSE 0.0 END), 6) AS improved FROM lineitem GROUP BY 1")
def median_summary(spark, sf_dir):
    d = F.col("l_tax") - F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(d)).alias("mean"), r6(F.median(d)).alias("median"), r6(F.min(d)).alias("min"), r6(F.max(d)).alias("max"), r6(F.avg((F.col("l_tax") > F.col("l_discount")).cast("double"))).alias("improved"))


@query("size_histogram", "SELECT n AS size, count(*) AS groups FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def size_histogram(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query(
    "nested_group",
    """WITH g AS (SELECT l_orderkey, l_returnflag, list(l_partkey ORDER BY l_partkey) AS parts, min(l_partkey) AS representative FROM lineitem GROUP BY ALL)
       SELECT l_orderkey, count(*) AS domains, array_to_string(list(l_returnflag || ':' || array_to_string(parts, ',') ORDER BY l_returnflag), ';') AS golds, min(representative) AS representative FROM g GROUP BY 1""",
)
def nested_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_partkey")
    inner = lines.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    outer = inner.groupBy("l_orderkey").agg(F.count("*").alias("domains"), F.array_sort(F.collect_list(F.struct("l_returnflag", "parts"))).alias("g"), F.min(F.col("parts")[0]).alias("representative"))
    golds = F.array_join(F.transform("g", lambda x: F.concat(x["l_returnflag"], F.lit(":"), F.array_join(x["parts"].cast("array<string>"), ","))), ";")
    return outer.select("l_orderkey", "domains", golds.alias("golds"), "representative")


@query(
    "logsumexp",
    """SELECT l_orderkey, round(m + ln(s), 6) AS lse, round(m + ln(s) - ln(n), 6) AS lme, round(m, 6) AS best FROM (SELECT l_orderkey, any_value(m) AS m, sum(exp(l_quantity / 10 - m)) AS s, count(*) AS n FROM (SELECT *, max(l_quantity / 10) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1)""",
)
def logsumexp(spark, sf_dir):
    """Two steps: the maximum, then the sum of exponentials below it."""
    x = F.transform("xs", lambda v: F.exp(v - F.array_max("xs")))
    grouped = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity") / 10)).alias("xs"))
    lse = F.array_max("xs") + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + v))
    return grouped.select("l_orderkey", r6(lse).alias("lse"), r6(lse - F.log(F.size("xs"))).alias("lme"), r6(F.array_max("xs")).alias("best"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"


def tfidf(docs: DataFrame, doc: str, tokens: Column, top: int) -> DataFrame:
    """The terms of highest tf * ln(N / (1 + df)) of each document."""
    tf = docs.select(doc, F.explode(tokens).alias("term")).groupBy(doc, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", r6(F.col("tf") * F.log(F.col("n") / (1 + F.col("df")))))  # n: one row
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(doc, "term", "score", "rank")


@query(
    "tfidf_topk",
    f"""WITH tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM benchmark),
        s AS (SELECT item_id, term, round(tf * ln(n / (1 + df)), 6) + 0.0 AS score FROM tf JOIN df USING (term), n)
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, term)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
)
def tfidf_topk(spark, sf_dir):
    return tfidf(table(spark, sf_dir, "benchmark"), "item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), 5)


_FAMILY = "CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'core' WHEN source IN ('src3', 'src4') THEN 'extra' ELSE 'other' END"


@query("rollup_family", f"SELECT family, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {_FAMILY} AS family, count(*) AS n FROM documents GROUP BY 1)")
def rollup_family(spark, sf_dir):
    families = {"src0": "core", "src1": "core", "src2": "core", "src3": "extra", "src4": "extra"}
    lookup = F.create_map(*[F.lit(x) for p in families.items() for x in p])
    counts = documents(spark, sf_dir, "source").groupBy(F.coalesce(F.try_element_at(lookup, F.col("source")), F.lit("other")).alias("family")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(whole())))


@query("role_pattern", "SELECT pattern, count(*) AS n FROM (SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS pattern FROM conversations GROUP BY 1) GROUP BY 1")
def role_pattern(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"))
    return turns.groupBy(F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("pattern")).agg(F.count("*").alias("n"))


@query("funnel", "SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE lang = 'en' AND n_chars >= 200) AS long_enough, count(*) FILTER (WHERE lang = 'en' AND n_chars >= 200 AND quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id)")
def funnel(spark, sf_dir):
    rows = documents(spark, sf_dir, "doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    a = F.col("lang") == "en"
    b = a & (F.col("n_chars") >= 200)
    return rows.agg(F.count("*").alias("n"), F.count(F.when(a, 1)).alias("english"), F.count(F.when(b, 1)).alias("long_enough"), F.count(F.when(b & (F.col("quality") == 1), 1)).alias("good"))


@query(
    "prefix_depth",
    """WITH c AS (SELECT l_orderkey, l_returnflag AS a, l_linestatus AS b, l_suppkey % 3 AS c FROM lineitem), g AS (SELECT l_orderkey, min(a) AS ga, min(b) AS gb, min(c) AS gc FROM c GROUP BY 1)
       SELECT l_orderkey, count(DISTINCT a) AS n_a, count(DISTINCT (a, b)) AS n_ab, count(DISTINCT (a, b, c)) AS n_abc, max(CASE WHEN a <> ga THEN 0 WHEN b <> gb THEN 1 WHEN c <> gc THEN 2 ELSE 3 END) AS depth FROM c JOIN g USING (l_orderkey) GROUP BY 1""",
)
def prefix_depth(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_suppkey") % 3).alias("c"))
    gold = codes.groupBy("l_orderkey").agg(*[F.min(x).alias(f"g{x}") for x in "abc"])
    depth = F.when(F.col("a") != F.col("ga"), 0).when(F.col("b") != F.col("gb"), 1).when(F.col("c") != F.col("gc"), 2).otherwise(3)
    return codes.join(gold, "l_orderkey").groupBy("l_orderkey").agg(F.countDistinct("a").alias("n_a"), F.countDistinct("a", "b").alias("n_ab"), F.countDistinct("a", "b", "c").alias("n_abc"), F.max(depth).alias("depth"))


@query("share_of_total", "SELECT role, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / (SELECT sum(length(text)) FROM conversations), 6) AS share FROM conversations GROUP BY 1")
def share_of_total(spark, sf_dir):
    sums = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.length("text").cast("long")).alias("chars"))
    return sums.withColumn("share", r6(F.col("chars") / F.sum("chars").over(whole())))


@query("best_text", "SELECT p_brand, max_by(p_name, (length(p_name), -p_partkey)) AS caption FROM part WHERE length(p_name) BETWEEN 8 AND 500 AND NOT starts_with(p_name, '[') GROUP BY 1")
def best_text(spark, sf_dir):
    usable = part(spark, sf_dir).filter(F.length("p_name").between(8, 500) & ~F.col("p_name").startswith("["))
    return usable.groupBy("p_brand").agg(F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey"))).alias("caption"))


_TAGGED = f"SELECT user_id, p_type AS lv1, p_type || '-' || p_brand AS lv2 FROM ({TIMELINE}) JOIN part ON item = p_partkey"


@query(
    "history_topcats",
    f"""WITH t AS ({_TAGGED}), e AS (SELECT user_id, unnest([1, 2]) AS level, unnest([lv1, lv2]) AS cat FROM t), c AS (SELECT user_id, level, cat, count(*) AS n FROM e GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id, level ORDER BY n DESC, cat) AS rk, sum(n) OVER (PARTITION BY user_id, level) AS t FROM c)
        SELECT user_id, level, string_agg(cat || ':' || n, ',' ORDER BY rk) AS top FROM r WHERE t >= 5 AND rk <= CASE level WHEN 1 THEN 4 ELSE 6 END GROUP BY ALL""",
)
def history_topcats(spark, sf_dir):
    tags = timeline(spark, sf_dir).join(part(spark, sf_dir).select(F.col("p_partkey").alias("item"), "p_type", "p_brand"), "item")
    each = tags.select("user_id", F.expr("stack(2, 1, p_type, 2, concat(p_type, '-', p_brand)) AS (level, cat)"))
    counts = each.groupBy("user_id", "level", "cat").agg(F.count("*").alias("n"))
    own = Window.partitionBy("user_id", "level")
    ranked = counts.withColumn("rk", F.row_number().over(own.orderBy(F.desc("n"), "cat"))).withColumn("t", F.sum("n").over(own))
    kept = ranked.filter((F.col("t") >= 5) & (F.col("rk") <= F.when(F.col("level") == 1, 4).otherwise(6)))
    listed = kept.groupBy("user_id", "level").agg(F.array_sort(F.collect_list(F.struct("rk", F.concat_ws(":", "cat", F.col("n").cast("string")).alias("s")))).alias("l"))
    return listed.select("user_id", "level", F.array_join(F.transform("l", lambda x: x["s"]), ",").alias("top"))


@query(
    "exposure_profile",
    """WITH seed AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0), added AS (SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1), b AS (SELECT DISTINCT p_brand FROM seed WHERE p_size < 10)
       SELECT round(avg(CASE WHEN s.p_brand IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS seen_share, round(avg(CASE WHEN b.p_brand IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unseen_prefix FROM added a LEFT JOIN seed s ON a.p_brand = s.p_brand AND a.p_size = s.p_size LEFT JOIN b ON a.p_brand = b.p_brand""",
)
def exposure_profile(spark, sf_dir):
    parts = part(spark, sf_dir)
    seed = parts.filter("p_partkey % 2 = 0").select("p_brand", "p_size").distinct()
    prefixes = seed.filter("p_size < 10").select("p_brand").distinct().withColumn("known", F.lit(1.0))
    added = parts.filter("p_partkey % 2 = 1").select("p_brand", "p_size")
    rows = added.join(seed.withColumn("seen", F.lit(1.0)), ["p_brand", "p_size"], "left").join(prefixes, "p_brand", "left")
    return rows.agg(F.round(F.avg(F.coalesce("seen", F.lit(0.0))), 6).alias("seen_share"), F.round(F.avg(1 - F.coalesce("known", F.lit(0.0))), 6).alias("unseen_prefix"))


def rejected(docs: DataFrame) -> DataFrame:
    return docs.withColumn("reasons", document_reasons()).filter(F.size("reasons") > 0)

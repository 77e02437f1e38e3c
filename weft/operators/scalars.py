"""Hashes, dates, arrays, vectors, JSON paths and exact binomial bounds."""

from __future__ import annotations

import math
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.expr import array_total, is_subsequence, let, r6, shared_prefix
from weft.operators.projections import TIMELINE, timeline
from weft.registry import query
from weft.sources.tables import table


def multiset_hash(df: DataFrame, row_hash: Column) -> DataFrame:
    """Number of rows and an order-independent hash of a dataset, without gathering the rows.

    Row hashes are summed: per-row 60-bit parts in exact decimals, so partial sums combine.
    """
    part = lambda i: F.conv(F.substring(row_hash, i, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(part(1)).cast("string").alias("a"), F.sum(part(16)).cast("string").alias("b"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def orthogonal_residual(a: Column, b: Column, strength: float) -> Column:
    """a + strength * (b without its part along a)."""
    along = dot(a, b) / F.greatest(dot(a, a), F.lit(1e-30))
    return let(along, lambda k: F.zip_with(a, b, lambda x, y: x.cast("double") + F.lit(strength) * (y.cast("double") - k * x.cast("double"))))


def log_softmax(logits: Column) -> Column:
    norm = let(F.array_max(logits), lambda top: F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top)
    return let(norm, lambda n: F.transform(logits, lambda x: x - n))


def forward_kl(teacher: Column, student: Column) -> Column:
    """KL(teacher || student) of two arrays of logits."""
    return array_total(F.zip_with(log_softmax(teacher), log_softmax(student), lambda p, q: F.exp(p) * (p - q)))


def even_positions(n: Column, limit: int) -> Column:
    """At most ``limit`` evenly spaced places of n, first and last among them."""
    k = F.least(n, F.lit(limit))
    return F.when(k <= 1, F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n - 1) / (k - 1)).cast("int")))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function for whole a and b, as a binomial tail."""
    n = int(a + b - 1)
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(x) + (n - i) * math.log1p(-x) for i in range(int(a), n + 1)] if 0 < x < 1 else []
    return math.fsum(map(math.exp, logs)) if logs else float(x >= 1)


@cache
def cp_lower(successes: int, trials: int, alpha: float = 0.05) -> float:
    """Clopper-Pearson lower bound of a success rate, by bisection."""
    if successes <= 0 or trials <= 0:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, successes, trials - successes + 1) < alpha else (low, mid)
    return low


def minimum_trials(target: float, alpha: float = 0.05) -> int:
    """Fewest trials without an error whose bound alpha^(1/n) reaches the target."""
    return math.ceil(math.log(alpha) / math.log(target))


@F.pandas_udf(T.DoubleType())
def cp_lower_column(successes: pd.Series, trials: pd.Series) -> pd.Series:
    return pd.Series([round(cp_lower(int(s), int(n)), 6) for s, n in zip(successes, trials, strict=True)])


def strict_time(text: Column) -> Column:
    """An ISO-8601 time that must name its zone; null otherwise."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


@query("row_hash", "SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || role || '|' || text) AS sha, md5(text) AS md5 FROM conversations")
def row_hash(spark, sf_dir):
    row = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(row, 256).alias("sha"), F.md5("text").alias("md5"))


@query("multiset_hash", "SELECT count(*) AS n, sum(('0x' || substr(md5(text), 1, 15))::BIGINT)::VARCHAR AS a, sum(('0x' || substr(md5(text), 16, 15))::BIGINT)::VARCHAR AS b FROM documents")
def multiset_hash_query(spark, sf_dir):
    return multiset_hash(table(spark, sf_dir, "documents", "text"), F.md5("text"))


@query("daily_count", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_count(spark, sf_dir):
    return table(spark, sf_dir, "events", "ts").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("hourly_count", "SELECT hour(ts + INTERVAL 8 HOUR)::INTEGER AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_count(spark, sf_dir):
    """Hours of a zone eight hours ahead."""
    return table(spark, sf_dir, "events", "ts").groupBy(F.hour(F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("hour")).agg(F.count("*").alias("n"))


@query("parse_date", "SELECT o_orderkey, epoch_ms(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d')) AS ms FROM orders")
def parse_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(F.to_timestamp(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")).alias("ms"))


@query("lag_to_ts", "SELECT l_orderkey, l_linenumber, epoch_ms(l_shipdate) - l_linenumber * 86400000::BIGINT AS by_days, epoch_ms(l_shipdate) - l_linenumber * 3600000::BIGINT AS by_hours FROM lineitem")
def lag_to_ts(spark, sf_dir):
    """Times from an anchor and a lag, in days or in hours."""
    anchor = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    back = lambda unit: anchor - F.col("l_linenumber").cast("long") * F.lit(unit).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", back(86_400_000).alias("by_days"), back(3_600_000).alias("by_hours"))


@query("leakage_check", f"SELECT max(ts) FILTER (WHERE event_id % 10 < 9) <= min(ts) FILTER (WHERE event_id % 10 = 9) AS clean, (epoch_ms(max(ts)) - epoch_ms(min(ts))) // 86400000 AS span_days FROM ({TIMELINE})")
def leakage_check(spark, sf_dir):
    current = F.col("event_id") % 10 == 9
    ms = F.unix_millis("ts")
    return timeline(spark, sf_dir).agg((F.max(F.when(~current, F.col("ts"))) <= F.min(F.when(current, F.col("ts")))).alias("clean"), F.floor((F.max(ms) - F.min(ms)) / 86_400_000).alias("span_days"))


@query("leakage_per_user", f"WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_id % 10 < 9) AS h, min(ts) FILTER (WHERE event_id % 10 = 9) AS c FROM ({TIMELINE}) GROUP BY 1) SELECT count(*) AS users, count(*) FILTER (WHERE c >= h) AS clean FROM u WHERE h IS NOT NULL AND c IS NOT NULL")
def leakage_per_user(spark, sf_dir):
    current = F.col("event_id") % 10 == 9
    users = timeline(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(~current, F.col("ts"))).alias("h"), F.min(F.when(current, F.col("ts"))).alias("c")).dropna()
    return users.agg(F.count("*").alias("users"), F.count(F.when(F.col("c") >= F.col("h"), 1)).alias("clean"))


@query("iso_utc", "SELECT event_id, event_id % 2 = 0 AS valid, CASE WHEN event_id % 2 = 0 THEN epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def iso_utc(spark, sf_dir):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", strict_time(stamp).isNotNull().alias("valid"), F.unix_millis(strict_time(stamp)).alias("ms"))


@query(
    "missing_months",
    "WITH d AS (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS m FROM lineitem), s AS (SELECT l_suppkey, unnest(generate_series(min(m)::TIMESTAMP, max(m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM d GROUP BY 1) SELECT l_suppkey, strftime(m, '%Y-%m') AS month FROM (SELECT * FROM s EXCEPT SELECT * FROM d)",
)
def missing_months(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "month").alias("m")).distinct()
    spine = months.groupBy("l_suppkey").agg(F.sequence(F.min("m"), F.max("m"), F.expr("INTERVAL 1 MONTH")).alias("s")).select("l_suppkey", F.explode("s").alias("m"))
    return spine.join(months, ["l_suppkey", "m"], "left_anti").select("l_suppkey", F.date_format("m", "yyyy-MM").alias("month"))


def _beams(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 9).alias("xs"))


BEAMS = "SELECT l_orderkey, list(l_partkey % 9 ORDER BY l_linenumber, l_partkey) AS xs FROM lineitem GROUP BY 1"


@query("list_length", f"SELECT l_orderkey, len(xs) AS n, xs[-3:] AS tail FROM ({BEAMS})")
def list_length(spark, sf_dir):
    n = F.coalesce(F.size("xs"), F.lit(0))
    return _beams(spark, sf_dir).select("l_orderkey", n.cast("long").alias("n"), F.slice("xs", -F.least(n, F.lit(3)), 3).alias("tail"))


@query("ordered_subseq", f"SELECT l_orderkey, CASE WHEN len(xs) = 1 THEN true WHEN len(xs) >= 2 THEN list_position(xs, xs[-1]) < len(xs) AND len(list_filter(xs[list_position(xs, xs[-1]) + 1:], lambda x: x = xs[1])) > 0 OR xs[1] = xs[-1] AND len(list_filter(xs, lambda x: x = xs[1])) > 1 ELSE true END AS reversed_in FROM ({BEAMS}) WHERE len(xs) > 1")
def ordered_subseq(spark, sf_dir):
    """Whether (last, first) appears in a list in that order."""
    pair = F.array(F.element_at("xs", -1), F.element_at("xs", 1))
    return _beams(spark, sf_dir).filter(F.size("xs") > 1).select("l_orderkey", is_subsequence(pair, F.col("xs")).alias("reversed_in"))


@query("first_divergence", f"WITH b AS (SELECT l_orderkey, xs, list_sort(xs) AS ys FROM ({BEAMS})) SELECT l_orderkey, coalesce(list_position([xs[i] <> ys[i] FOR i IN range(1, len(xs) + 1)], true) - 1, len(xs))::INTEGER AS shared FROM b")
def first_divergence(spark, sf_dir):
    return _beams(spark, sf_dir).select("l_orderkey", shared_prefix(F.col("xs"), F.array_sort("xs")).alias("shared"))


@query("list_repeat", f"WITH e AS (SELECT l_orderkey, x, count(*) AS n FROM (SELECT l_orderkey, unnest(xs) AS x FROM ({BEAMS})) GROUP BY ALL) SELECT l_orderkey, (sum(n) - count(*))::BIGINT AS repeated, max(n) AS most FROM e GROUP BY 1")
def list_repeat(spark, sf_dir):
    most = F.array_max(F.transform(F.array_distinct("xs"), lambda x: F.size(F.filter("xs", lambda y: y == x))))
    return _beams(spark, sf_dir).select("l_orderkey", (F.size("xs") - F.size(F.array_distinct("xs"))).cast("long").alias("repeated"), most.cast("long").alias("most"))


def _vector_pairs(spark, sf_dir):
    """Neighbouring vectors (vec_id, vec_id + 1) as a keyed join."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


_PAIRS = "SELECT a.vec_id, [x::DOUBLE FOR x IN a.embedding] AS a, [x::DOUBLE FOR x IN b.embedding] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@query("orthogonal_residual", f"WITH p AS ({_PAIRS}), r AS (SELECT vec_id, a, b, list_inner_product(a, b) / list_inner_product(a, a) AS k FROM p) SELECT vec_id, round(k, 6) + 0.0 AS along, round(a[1] + 0.5 * (b[1] - k * a[1]), 6) + 0.0 AS first FROM r")
def orthogonal_residual_query(spark, sf_dir):
    a, b = F.col("embedding"), F.col("other")
    return _vector_pairs(spark, sf_dir).select("vec_id", r6(dot(a, b) / dot(a, a)).alias("along"), r6(orthogonal_residual(a, b, 0.5)[0]).alias("first"))


@query(
    "forward_kl",
    f"WITH p AS ({_PAIRS}), l AS (SELECT vec_id, [x - list_max(a) - ln(list_sum([exp(y - list_max(a)) FOR y IN a])) FOR x IN a] AS p, [x - list_max(b) - ln(list_sum([exp(y - list_max(b)) FOR y IN b])) FOR x IN b] AS q FROM p) SELECT vec_id, round(list_sum([exp(x[1]) * (x[1] - x[2]) FOR x IN list_zip(p, q)]), 6) + 0.0 AS kl FROM l",
)
def forward_kl_query(spark, sf_dir):
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    return _vector_pairs(spark, sf_dir).select("vec_id", r6(forward_kl(wide("embedding"), wide("other"))).alias("kl"))


@query("even_positions", f"SELECT l_orderkey, CASE WHEN len(xs) = 1 THEN [0] ELSE [floor(i * (len(xs) - 1) / (least(len(xs), 4) - 1))::INTEGER FOR i IN range(least(len(xs), 4))] END AS places FROM ({BEAMS})")
def even_positions_query(spark, sf_dir):
    return _beams(spark, sf_dir).select("l_orderkey", even_positions(F.size("xs"), 4).alias("places"))


@query("json_path", "SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("list_parse", "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_partkey % 4 > 0) AS parsed, sum(CASE WHEN p_partkey % 4 > 0 THEN 2 ELSE 0 END)::BIGINT AS tags FROM part GROUP BY 1")
def list_parse(spark, sf_dir):
    """Lists written with single quotes, parsed after the quotes are rewritten; broken ones count as failures."""
    written = F.concat(F.lit("['"), F.col("p_brand"), F.lit("', '"), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, "'").otherwise("']"))
    text = F.regexp_replace(written, "'", '"')
    parsed = F.when(text.endswith("]"), F.from_json(text, "array<string>"))
    rows = table(spark, sf_dir, "part").select("p_type", parsed.alias("l"))
    return rows.groupBy("p_type").agg(F.count("*").alias("n"), F.count("l").alias("parsed"), F.coalesce(F.sum(F.size("l")), F.lit(0)).cast("long").alias("tags"))


@query("map_lookup", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_brand WHEN 2 THEN p_name WHEN 3 THEN p_size::VARCHAR END AS chosen FROM part")
def map_lookup(spark, sf_dir):
    options = F.map_from_arrays(F.array(*map(F.lit, "ABCD")), F.array("p_type", "p_brand", "p_name", F.col("p_size").cast("string")))
    letter = F.substring(F.lit("ABCDE"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey", F.try_element_at(options, letter).alias("chosen"))


@query("cp_zero_error", "SELECT event_type, n, round(0.05 ** (1.0 / n), 6) AS lower FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def cp_zero_error(spark, sf_dir):
    counts = table(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("lower", F.round(F.pow(F.lit(0.05), F.lit(1.0) / F.col("n")), 6))


@query("cp_lower")
def cp_lower_query(spark, sf_dir):
    counts = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 10).alias("bucket")).agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return counts.withColumn("lower", cp_lower_column(F.col("good"), F.col("n")))


def mean_gold_logp(logits: Column, gold: Column) -> Column:
    """Mean log-probability of the gold places (0-based) of an array of logits."""
    logs = log_softmax(logits)
    return array_total(F.transform(gold, lambda i: F.element_at(logs, i + 1))) / F.size(gold)

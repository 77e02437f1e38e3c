"""Window and ordered-sequence operators over user timelines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.expr import hash_rank, hash_rank_sql, r6
from weft.operators.projections import TIMELINE, timeline
from weft.registry import query
from weft.sources.tables import table


def gaps(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Positive gaps in seconds between a user's neighbouring events."""
    us = F.unix_micros(ts)
    gap = us - F.lag(us).over(Window.partitionBy(user).orderBy(us))
    return events.select(user, (gap / 1_000_000).alias("gap")).filter("gap > 0")


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """Ranks in which ties share the mean of their places; groups must be of bounded size, or ``value``
    already distinct."""
    w = Window.partitionBy(*by).orderBy(value)
    peers = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(peers) - 1) / 2)


def latest_unique(events: DataFrame, user: str, item: str, limit: int) -> DataFrame:
    """Each user's latest ``limit`` distinct items, oldest first, as an array.

    Items are reduced to their latest event by a grouping, so the window sorts distinct items only.
    """
    last = events.groupBy(user, item).agg(F.max(F.struct("ts", "event_id")).alias("at"))
    ranked = last.withColumn("r", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("at")))).filter(F.col("r") <= limit)
    return ranked.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), item))), lambda x: x[item]).alias("items"))


def tail(events: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The last events of each key, numbered from the latest (``r`` = 1)."""
    w = Window.partitionBy(*by).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit)


def greedy_caps(df: DataFrame, order: list[str], caps: dict[str, int], total: int) -> DataFrame:
    """Rows taken in order as long as the total and every column's cap per value allow it.

    The decision on a row depends on all before it, so this part runs in one task.  Before it, a row is
    dropped if ``min(caps)`` rows with the same values in all the capped columns come earlier: they
    would be taken or refused in its place.  What is left is bounded by the number of values.
    """
    columns = df.columns
    alike = Window.partitionBy(*caps).orderBy(*order)
    df = df.withColumn("_alike", F.row_number().over(alike)).filter(F.col("_alike") <= min(caps.values())).drop("_alike")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[tuple, int] = {}
        n = 0
        for batch in batches:
            keep = []
            for row in batch.itertuples(index=False):
                keys = [(c, getattr(row, c)) for c in caps]
                if n < total and all(used.get(k, 0) < caps[k[0]] for k in keys):
                    n += 1
                    for k in keys:
                        used[k] = used.get(k, 0) + 1
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch[keep]

    return df.orderBy(*order).coalesce(1).mapInPandas(take, df.schema).select(*columns)


def increasing_chain(events: DataFrame, by: list[str], level: Column, least: int) -> DataFrame:
    """Greedy chains per key: each next event has a higher level, a later day and a new item.

    One fold over the key's events in time order, inside the JVM.
    """
    step = F.struct(F.col("ts"), F.col("event_id"), level.alias("level"), F.to_date("ts").alias("day"), F.col("item"))
    chain = F.aggregate(
        F.array_sort(F.collect_list(step)),
        F.expr("cast(array() as array<struct<ts:timestamp,event_id:bigint,level:int,day:date,item:bigint>>)"),
        lambda held, x: F.when(
            (F.size(held) == 0) | ((x["level"] > F.element_at(held, -1)["level"]) & (x["day"] > F.element_at(held, -1)["day"]) & ~F.exists(held, lambda h: h["item"] == x["item"])),
            F.concat(held, F.array(x)),
        ).otherwise(held),
    )
    return events.groupBy(*by).agg(chain.alias("chain")).filter(F.size("chain") >= least)


def timeline_text(events: DataFrame, by: str) -> DataFrame:
    """A text per key: a header for each new date, then a line per event."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    line = F.concat_ws("\n", F.when(F.coalesce(F.lag(day).over(w) != day, F.lit(True)), F.concat(F.lit("# "), day)), F.concat(F.lit("- "), F.col("action"), F.lit(" "), F.col("item").cast("string")))
    lines = events.select(by, "ts", "event_id", line.alias("line"))
    return lines.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


def islands(events: DataFrame, by: str, run_of: Column) -> DataFrame:
    """Numbers runs of neighbouring events of equal ``run_of``."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    fresh = F.coalesce((F.lag(run_of).over(w) != run_of).cast("int"), F.lit(1))
    return events.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


@query("session_gap", f"WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS us FROM events) SELECT user_id, count(*) AS gaps, round(min(us) / 1000000, 6) AS shortest, round(max(us) / 1000000, 6) AS longest FROM g WHERE us > 0 GROUP BY 1")
def session_gap(spark, sf_dir):
    found = gaps(table(spark, sf_dir, "events", "user_id", F.col("ts").cast("timestamp").alias("ts")))
    return found.groupBy("user_id").agg(F.count("*").alias("gaps"), F.round(F.min("gap"), 6).alias("shortest"), F.round(F.max("gap"), 6).alias("longest"))


@query("session_break_rate", "WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS us FROM events) SELECT round(avg(CASE WHEN us > 1800000000 THEN 1.0 ELSE 0.0 END), 6) AS over_half_hour, round(avg(CASE WHEN us > 86400000000 THEN 1.0 ELSE 0.0 END), 6) AS over_day FROM g WHERE us > 0")
def session_break_rate(spark, sf_dir):
    found = gaps(table(spark, sf_dir, "events", "user_id", F.col("ts").cast("timestamp").alias("ts")))
    over = lambda s: F.round(F.avg((F.col("gap") > s).cast("double")), 6)
    return found.agg(over(1800).alias("over_half_hour"), over(86400).alias("over_day"))


@query("avg_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2 AS avg_rank FROM part")
def avg_rank(spark, sf_dir):
    return average_rank(table(spark, sf_dir, "part", "p_partkey", "p_type", "p_size"), "p_size", ["p_type"], "avg_rank").select("p_partkey", "avg_rank")


@query("cdf", "SELECT p_size, round(sum(count(*)) OVER (ORDER BY p_size) / sum(count(*)) OVER (), 6) AS cdf FROM part GROUP BY 1")
def cdf(spark, sf_dir):
    counts = table(spark, sf_dir, "part", "p_size").groupBy("p_size").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select("p_size", r6(F.sum("n").over(every.orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every)).alias("cdf"))


@query(
    "latest_unique",
    f"""WITH l AS (SELECT user_id, item, max((ts, event_id)) AS latest FROM ({TIMELINE}) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC) AS r FROM l) SELECT user_id, list(item ORDER BY r DESC) AS items FROM r WHERE r <= 10 GROUP BY 1""",
)
def latest_unique_query(spark, sf_dir):
    return latest_unique(timeline(spark, sf_dir), "user_id", "item", 10)


@query("ordered_distinct", f"WITH f AS (SELECT user_id, action, min((ts, event_id)) AS earliest FROM ({TIMELINE}) GROUP BY ALL) SELECT user_id, string_agg(action, '>' ORDER BY earliest) AS actions FROM f GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    first = timeline(spark, sf_dir).groupBy("user_id", "action").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "action"))).alias("l"))
    return listed.select("user_id", F.array_join(F.transform("l", lambda x: x["action"]), ">").alias("actions"))


@query("tail_k", f"SELECT user_id, domain, event_id, row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, event_id DESC)::INTEGER AS r FROM ({TIMELINE}) QUALIFY r <= 5")
def tail_k(spark, sf_dir):
    return tail(timeline(spark, sf_dir), ["user_id", "domain"], 5).select("user_id", "domain", "event_id", "r")


@query("recency_weight", f"SELECT event_id, round(0.05 * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 6) AS weight FROM ({TIMELINE})")
def recency_weight(spark, sf_dir):
    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "event_id")) - 1
    return timeline(spark, sf_dir).select("event_id", r6(F.lit(0.05) * place / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("weight"))


@query(
    "leave_one_out",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM ({TIMELINE})), t AS (SELECT user_id, max(item) FILTER (WHERE r = 1) AS target, list(item ORDER BY r DESC) FILTER (WHERE r > 1) AS history FROM r WHERE r <= 11 GROUP BY 1)
        SELECT user_id, target, history FROM t WHERE len(history) > 0 AND NOT list_contains(history, target)""",
)
def leave_one_out(spark, sf_dir):
    recent = tail(timeline(spark, sf_dir), ["user_id"], 11)
    users = recent.groupBy("user_id").agg(F.max(F.when(F.col("r") == 1, F.col("item"))).alias("target"), F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, F.struct((-F.col("r")).alias("r"), "item")))), lambda x: x["item"]).alias("history"))
    return users.filter((F.size("history") > 0) & ~F.array_contains("history", F.col("target")))


@query("forward_fill", f"SELECT event_id, last_value(CASE WHEN action = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM ({TIMELINE})")
def forward_fill_query(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return timeline(spark, sf_dir).select("event_id", F.last(F.when(F.col("action") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("header"))


@query("cap_per_group", f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {hash_rank_sql('cap', 'doc_id')}, doc_id) <= 7")
def cap_per_group(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(hash_rank("cap", "doc_id"), "doc_id")
    return table(spark, sf_dir, "documents", "doc_id", "source").withColumn("r", F.row_number().over(w)).filter("r <= 7").drop("r")


@query(
    "greedy_caps",
    f"""WITH RECURSIVE o AS (SELECT doc_id, source, lang, row_number() OVER (ORDER BY {hash_rank_sql('greedy', 'doc_id')}, doc_id) AS n FROM documents),
        c AS (SELECT 0::BIGINT AS n, []::VARCHAR[] AS sources, []::VARCHAR[] AS langs, NULL::BIGINT AS doc_id, true AS took
              UNION ALL SELECT n, CASE WHEN took THEN list_append(sources, source) ELSE sources END, CASE WHEN took THEN list_append(langs, lang) ELSE langs END, doc_id, took
              FROM (SELECT o.n, o.doc_id, source, lang, sources, langs, len(list_filter(sources, lambda x: x = source)) < 6 AND len(list_filter(langs, lambda x: x = lang)) < 30 AS took FROM c JOIN o ON o.n = c.n + 1 WHERE len(sources) < 80))
        SELECT o.doc_id, o.source, o.lang FROM c JOIN o USING (doc_id) WHERE took""",
)
def greedy_caps_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang").withColumn("h", hash_rank("greedy", "doc_id"))
    return greedy_caps(docs, ["h", "doc_id"], {"source": 6, "lang": 30}, 80).drop("h")


@query("per_key_cap", f"SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {hash_rank_sql('key', 'p_partkey')}, p_partkey) <= 3")
def per_key_cap(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(hash_rank("key", "p_partkey"), "p_partkey")
    return table(spark, sf_dir, "part", "p_partkey", "p_brand").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("p_partkey")


LEVELS = {"view": 1, "click": 2, "signup": 3, "purchase": 4}


@query(
    "chain_increasing",
    f"""WITH RECURSIVE t AS (SELECT user_id, event_id, ts::DATE AS day, item, CASE action WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({TIMELINE})),
        c AS (SELECT user_id, n, level, day, [item] AS items, [event_id] AS event_ids FROM t WHERE n = 1
              UNION ALL SELECT user_id, n, CASE WHEN took THEN level ELSE l0 END, CASE WHEN took THEN day ELSE d0 END, CASE WHEN took THEN list_append(items, item) ELSE items END, CASE WHEN took THEN list_append(event_ids, event_id) ELSE event_ids END
              FROM (SELECT t.*, c.level AS l0, c.day AS d0, items, event_ids, t.level > c.level AND t.day > c.day AND NOT list_contains(items, t.item) AS took FROM c JOIN t ON t.user_id = c.user_id AND t.n = c.n + 1))
        SELECT user_id, len(event_ids)::INTEGER AS n, event_ids FROM c WHERE len(event_ids) >= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c.n DESC) = 1""",
)
def chain_increasing(spark, sf_dir):
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.col("action")), F.lit(0))
    chains = increasing_chain(timeline(spark, sf_dir), ["user_id"], level, 3)
    return chains.select("user_id", F.size("chain").alias("n"), F.transform("chain", lambda x: x["event_id"]).alias("event_ids"))


@query(
    "funnel_pattern",
    f"""WITH t AS ({TIMELINE}), b AS (SELECT user_id, domain, event_id, ts, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM t c WHERE c.user_id = p.user_id AND c.domain = p.domain AND c.action = 'click' AND (c.ts, c.event_id) < (p.ts, p.event_id)) AS click_id FROM t p WHERE action = 'purchase')
        SELECT b.event_id, b.click_id, (SELECT max_by(v.event_id, (v.ts, v.event_id)) FROM t v JOIN t c ON c.event_id = b.click_id WHERE v.user_id = b.user_id AND v.domain = b.domain AND v.action = 'view' AND (v.ts, v.event_id) < (c.ts, c.event_id)) AS view_id FROM b WHERE click_id IS NOT NULL""",
)
def funnel_pattern(spark, sf_dir):
    """view -> click -> purchase in one domain: each step carries the latest step before it forward."""
    w = Window.partitionBy("user_id", "domain").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    events = timeline(spark, sf_dir)
    seen = events.withColumn("view_id", F.last(F.when(F.col("action") == "view", F.col("event_id")), ignorenulls=True).over(w))
    click = F.last(F.when(F.col("action") == "click", F.struct(F.col("event_id").alias("click_id"), "view_id")), ignorenulls=True).over(w)
    return seen.withColumn("c", click).filter("action = 'purchase' AND c IS NOT NULL").select("event_id", "c.click_id", "c.view_id")


@query(
    "even_thin",
    f"""WITH r AS (SELECT user_id, event_id, action, row_number() OVER (PARTITION BY user_id, action = 'purchase' ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, action = 'purchase') AS n FROM ({TIMELINE}))
        SELECT user_id, event_id FROM r WHERE action = 'purchase' OR n <= 10 OR (i = 0) OR (i * 10 // n) <> ((i - 1) * 10 // n)""",
)
def even_thin(spark, sf_dir):
    """Keeps a chain's events whole and thins the others to ten evenly spaced ones."""
    w = Window.partitionBy("user_id", F.col("action") == "purchase")
    rows = timeline(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("n", F.count("*").over(w))
    slot = lambda i: F.floor(i * 10 / F.col("n"))
    return rows.filter((F.col("action") == "purchase") | (F.col("n") <= 10) | (F.col("i") == 0) | (slot(F.col("i")) != slot(F.col("i") - 1))).select("user_id", "event_id")


@query(
    "tiered_topk",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem), t AS (SELECT *, CASE WHEN rank BETWEEN 3 AND 4 THEN 0 WHEN l_partkey % 4 = 0 THEN 1 ELSE 2 END AS tier FROM r),
       c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, tier ORDER BY rank) AS in_tier FROM t) SELECT l_orderkey, l_partkey, tier FROM c WHERE in_tier <= 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, rank) <= 3""",
)
def tiered_topk(spark, sf_dir):
    """Candidates near the cut first, then by shared prefix, with a cap per tier."""
    by = Window.partitionBy("l_orderkey")
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").withColumn("rank", F.row_number().over(by.orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")))
    rows = rows.withColumn("tier", F.when(F.col("rank").between(3, 4), 0).when(F.col("l_partkey") % 4 == 0, 1).otherwise(2))
    capped = rows.withColumn("in_tier", F.row_number().over(Window.partitionBy("l_orderkey", "tier").orderBy("rank"))).filter("in_tier <= 2")
    return capped.withColumn("r", F.row_number().over(by.orderBy("tier", "rank"))).filter("r <= 3").select("l_orderkey", "l_partkey", "tier")


@query("tiered_argmin", f"SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber DESC, {hash_rank_sql('neg', 'l_partkey')}) = 1")
def tiered_argmin(spark, sf_dir):
    order = F.struct(F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("t"), (-F.col("l_linenumber")).alias("p"), hash_rank("neg", "l_partkey").alias("h"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", order).alias("l_partkey"))


@query("latest_per_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("l")).select("o_custkey", "l.o_orderkey", "l.o_orderstatus")


@query(
    "timeline_text",
    f"""WITH l AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts::DATE) OVER w IS DISTINCT FROM ts::DATE THEN '# ' || strftime(ts, '%Y-%m-%d') || chr(10) ELSE '' END || '- ' || action || ' ' || item AS line FROM ({TIMELINE}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, string_agg(line, chr(10) ORDER BY ts, event_id) AS text FROM l GROUP BY 1""",
)
def timeline_text_query(spark, sf_dir):
    return timeline_text(timeline(spark, sf_dir), "user_id")


@query(
    "grouped_render",
    f"""WITH t AS ({TIMELINE}), l AS (SELECT user_id, arg_max(domain, (ts, event_id)) AS target FROM t GROUP BY 1),
        k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_id, domain ORDER BY ts DESC, event_id DESC) <= 4),
        b AS (SELECT user_id, domain, string_agg(item::VARCHAR, ' ' ORDER BY ts, event_id) AS items FROM k GROUP BY 1, 2)
        SELECT user_id, string_agg(domain || ': ' || items, chr(10) ORDER BY domain = target, domain) AS text FROM b JOIN l USING (user_id) GROUP BY 1""",
)
def grouped_render(spark, sf_dir):
    """A block per domain with its latest items, the target's domain last."""
    events = timeline(spark, sf_dir)
    target = tail(events, ["user_id"], 1).select("user_id", F.col("domain").alias("target"))
    blocks = tail(events, ["user_id", "domain"], 4).groupBy("user_id", "domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("r"), "item"))), lambda x: x["item"].cast("string")), " ").alias("items"))
    joined = blocks.join(target, "user_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((F.col("domain") == F.col("target")).alias("last"), "domain", "items"))).alias("b"))
    return joined.select("user_id", F.array_join(F.transform("b", lambda x: F.concat(x["domain"], F.lit(": "), x["items"])), "\n").alias("text"))


@query(
    "islands",
    f"""WITH f AS (SELECT *, CASE WHEN lag(domain) OVER w IS DISTINCT FROM domain THEN 1 ELSE 0 END AS fresh FROM ({TIMELINE}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f)
        SELECT user_id, island::BIGINT AS island, any_value(domain) AS domain, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY ALL""",
)
def islands_query(spark, sf_dir):
    runs = islands(timeline(spark, sf_dir), "user_id", F.col("domain"))
    return runs.groupBy("user_id", "island").agg(F.first("domain").alias("domain"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    "best_candidate",
    f"""WITH c AS (SELECT l_orderkey, l_suppkey % 2 AS trace, count(DISTINCT l_partkey) AS hits, count(DISTINCT l_returnflag) AS diversity, count(*) AS valid, min(l_linenumber) AS tokens FROM lineitem GROUP BY ALL)
        SELECT l_orderkey, trace, hits FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY hits DESC, diversity DESC, valid DESC, tokens, {hash_rank_sql('trace', 'l_orderkey', 'trace')}) = 1""",
)
def best_candidate(spark, sf_dir):
    traces = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 2).alias("trace")).agg(F.countDistinct("l_partkey").alias("hits"), F.countDistinct("l_returnflag").alias("diversity"), F.count("*").alias("valid"), F.min("l_linenumber").alias("tokens"))
    order = F.struct(-F.col("hits"), -F.col("diversity"), -F.col("valid"), F.col("tokens"), hash_rank("trace", "l_orderkey", "trace"))
    return traces.groupBy("l_orderkey").agg(F.min_by(F.struct("trace", "hits"), order).alias("b")).select("l_orderkey", "b.trace", "b.hits")


@query(
    "ratio_negatives",
    f"""WITH t AS (SELECT *, count(*) FILTER (WHERE action = 'purchase') OVER (PARTITION BY user_id) AS pos FROM ({TIMELINE})), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {hash_rank_sql('wanted', 'event_id')}, event_id) AS r FROM t WHERE action <> 'purchase')
        SELECT user_id, event_id FROM n WHERE r <= least(greatest(3, 2 * pos), 30)""",
)
def ratio_negatives(spark, sf_dir):
    """As many negatives as a ratio of the positives asks for, within a floor and a budget."""
    events = timeline(spark, sf_dir)
    positives = events.withColumn("pos", F.count(F.when(F.col("action") == "purchase", 1)).over(Window.partitionBy("user_id")))
    others = positives.filter("action <> 'purchase'").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(hash_rank("wanted", "event_id"), "event_id")))
    return others.filter(F.col("r") <= F.least(F.greatest(F.lit(3), 2 * F.col("pos")), F.lit(30))).select("user_id", "event_id")

"""Joins: keyed, semi, anti, inverse-index, temporal and candidate joins.

Strategies are Catalyst's; ``broadcast`` is hinted only for configuration tables of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.expr import array_total, char_grams, ratio
from weft.operators.projections import TIMELINE, timeline
from weft.registry import query
from weft.sources.tables import table


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first by an explicit order (pass descending columns for the last)."""
    rest = [c for c in df.columns if c not in keys]
    ordering = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordering).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def inverse_index(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key -> all its values in order."""
    grouped = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_l"))
    return grouped.select(key, F.transform("_l", lambda x: x["v"]).alias("values"))


def orphans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of one side only, with that side."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def zip_lists(df: DataFrame, lists: list[str], keep: list[str]) -> DataFrame:
    """One row per position of parallel lists, cut to the shortest; null lists have none."""
    n = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in lists]) if len(lists) > 1 else F.coalesce(F.size(lists[0]), F.lit(0))
    zipped = F.slice(F.arrays_zip(*lists), 1, F.greatest(n, F.lit(0)))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_z")).select(*keep, "pos", *[F.col(f"_z.{c}") for c in lists])


def prior_match(events: DataFrame, target: Column, source: Column, on: list[str], value: str, name: str) -> DataFrame:
    """As-of join inside a key: for each target event, ``value`` of the latest earlier source event.

    One window pass over the union: no self-join, so a long timeline costs a sort, not a square.
    """
    w = Window.partitionBy(*on).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(source, F.col(value)), ignorenulls=True).over(w)).filter(target)


#: Rows up to which a counted side of a join is broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, broadcast if it is counted to hold no more rows than that; beyond, Spark joins it by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def gram_candidates(docs: DataFrame, probes: DataFrame, n: int, top: int, least: int) -> DataFrame:
    """Documents by the number of distinct character n-grams they share with a probe, the top ones of each.

    An inverted-index join: both sides are exploded to grams, joined on the gram, and counted.  A probe side
    of checked size is broadcast, so that only the grams that some probe has are shuffled, as counts.
    """
    d = docs.select("doc_id", F.explode(char_grams(F.col("text"), n)).alias("gram"))
    p = probes.select("item_id", F.explode(char_grams(F.col("text"), n)).alias("gram"))
    hits = d.join(broadcast_if_small(p), "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    w = Window.partitionBy("item_id").orderBy(F.desc("shared"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("join_inner", "SELECT l_orderkey, l_linenumber, p_type FROM lineitem JOIN part ON l_partkey = p_partkey")
def join_inner(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(table(spark, sf_dir, "part", F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").select("l_orderkey", "l_linenumber", "p_type")


@query("join_lookup_inner", f"SELECT event_id, p_brand FROM ({TIMELINE}) e JOIN part ON item = p_partkey")
def join_lookup_inner(spark, sf_dir):
    events = timeline(spark, sf_dir).select("event_id", "item")
    return events.join(parts_of(spark, sf_dir).select(F.col("p_partkey").alias("item"), "p_brand"), "item").select("event_id", "p_brand")


@query("join_lookup_left", f"SELECT event_id, coalesce(p_brand, '') AS p_brand FROM ({TIMELINE}) e LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) ON item = p_partkey")
def join_lookup_left(spark, sf_dir):
    some = parts_of(spark, sf_dir).filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"), "p_brand")
    return timeline(spark, sf_dir).select("event_id", "item").join(some, "item", "left").select("event_id", F.coalesce("p_brand", F.lit("")).alias("p_brand"))


@query("join_semi", f"SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT item FROM ({TIMELINE}) WHERE action = 'purchase')")
def join_semi(spark, sf_dir):
    bought = timeline(spark, sf_dir).filter("action = 'purchase'").select(F.col("item").alias("p_partkey"))
    return parts_of(spark, sf_dir).join(bought, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("join_anti", "SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "lang").join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti")


@query(
    "orphans",
    "SELECT c_custkey AS key, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
)
def orphans_query(spark, sf_dir):
    return orphans(table(spark, sf_dir, "customer", F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders", F.col("o_custkey").alias("key")), ["key"])


@query("inverse_index", "SELECT p_brand, p_size, list(p_partkey ORDER BY p_partkey) AS parts FROM part GROUP BY p_brand, p_size")
def inverse_index_query(spark, sf_dir):
    keyed = parts_of(spark, sf_dir).withColumn("code", F.struct("p_brand", "p_size"))
    return inverse_index(keyed, "code", "p_partkey", "p_partkey").select("code.p_brand", "code.p_size", F.col("values").alias("parts"))


@query("resolve_latest", "SELECT l_orderkey, l_linenumber, coalesce(latest, 0) AS resolved FROM lineitem LEFT JOIN (SELECT p_brand, p_size, max(p_partkey) AS latest FROM part GROUP BY ALL) ON p_brand = 'Brand#' || (l_suppkey % 30) AND p_size = l_linenumber")
def resolve_latest(spark, sf_dir):
    latest = parts_of(spark, sf_dir).groupBy("p_brand", "p_size").agg(F.max_by("p_partkey", "p_partkey").alias("latest"))
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("p_brand")).withColumn("p_size", F.col("l_linenumber"))
    return lines.join(latest, ["p_brand", "p_size"], "left").select("l_orderkey", "l_linenumber", F.coalesce("latest", F.lit(0)).alias("resolved"))


@query("first_wins", "SELECT p_name, min_by(p_partkey, p_partkey) AS p_partkey, min_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def first_wins(spark, sf_dir):
    return keep_first(parts_of(spark, sf_dir).select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


@query("last_wins", "SELECT p_name, max(p_partkey) AS p_partkey, max_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def last_wins(spark, sf_dir):
    return keep_first(parts_of(spark, sf_dir).select("p_name", "p_partkey", "p_brand"), ["p_name"], [-F.col("p_partkey")])


@query(
    "zip_lists",
    """WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, list(l_suppkey ORDER BY l_linenumber, l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS supps FROM lineitem GROUP BY 1)
       SELECT l_orderkey, (i - 1)::INTEGER AS pos, parts[i] AS parts, supps[i] AS supps FROM g, unnest(range(1, least(len(parts), len(coalesce(supps, []))) + 1)) t(i)""",
)
def zip_lists_query(spark, sf_dir):
    by_line = lambda c, keep=None: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("l_linenumber", c)) if keep is not None else F.struct("l_linenumber", c))), lambda x: x[c])
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lists = lines.groupBy("l_orderkey").agg(by_line("l_partkey").alias("parts"), by_line("l_suppkey", F.col("l_returnflag") != "R").alias("supps"))
    return zip_lists(lists, ["parts", "supps"], ["l_orderkey"])


@query(
    "full_outer_coverage",
    """SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def full_outer_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").withColumn("l", F.lit(1))
    r = table(spark, sf_dir, "labels", "doc_id").withColumn("r", F.lit(1))
    return d.join(r, "doc_id", "full").agg(F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"), F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"), F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("both"))


@query(
    "join_derived_key",
    """WITH p AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))) AS core FROM conversations WHERE role = 'user'),
       g AS (SELECT core, count(*) AS n, min(conv_id) AS first_conv FROM p GROUP BY core HAVING count(*) = 1)
       SELECT p.conv_id, p.turn, length(core) AS core_length FROM p JOIN g USING (core)""",
)
def join_derived_key(spark, sf_dir):
    """Rows aligned on a normalised key, of groups that hold exactly one."""
    core = F.lower(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", core.alias("core"))
    single = rows.groupBy("core").agg(F.count("*").alias("n")).filter("n = 1").select("core")
    return rows.join(single, "core").select("conv_id", "turn", F.length("core").cast("long").alias("core_length"))


@query(
    "overlap_argmax",
    f"""WITH t AS (SELECT DISTINCT user_id, item FROM ({TIMELINE}) WHERE action = 'purchase'), r AS (SELECT DISTINCT user_id AS row_user, item FROM ({TIMELINE}) WHERE action = 'view'),
        c AS (SELECT user_id, row_user, count(*) AS shared FROM t JOIN r USING (item) GROUP BY ALL)
        SELECT user_id, row_user, shared FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY shared DESC, row_user) = 1""",
)
def overlap_argmax(spark, sf_dir):
    """For each target, the row that shares most of its items."""
    events = timeline(spark, sf_dir)
    sets = lambda action, user: events.filter(F.col("action") == action).groupBy(F.col("user_id").alias(user)).agg(F.array_sort(F.collect_set("item")).alias("items")).filter(F.size("items") > 0)
    return most_shared(sets("purchase", "user_id"), sets("view", "row_user")).select("user_id", "row_user", "shared")


#: Distinct sets of a side that one task of ``most_shared`` compares with as many of the other side.
SETS = 16_384


def most_shared(targets: DataFrame, rows: DataFrame, block: int = SETS) -> DataFrame:
    """``user_id, row_user, shared``: the row whose set shares most with a target's, of several the smallest.

    ``targets`` has ``user_id, items``, ``rows`` has ``row_user, items``, sorted distinct longs.  Equal sets are
    compared once.  Blocks of sets meet as a whole, and a task counts over inverted lists: a shared item costs an
    addition there, in place of a joined row.
    """
    wanted = targets.select("items").distinct()
    kept = rows.groupBy("items").agg(F.min("row_user").alias("row_user"))  # a null only if there is no other
    m, n = (-(-x.count() // block) or 1 for x in (wanted, kept))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    of = lambda k: F.pmod(F.xxhash64("items"), F.lit(k)).cast("int")
    left = wanted.select("items", of(m).alias("t"), every(n).alias("r"))
    right = kept.select("items", "row_user", every(m).alias("t"), of(n).alias("r"))
    found = left.groupBy("t", "r").cogroup(right.groupBy("t", "r")).applyInArrow(_best_rows, "items array<long>, row_user long, shared long")
    order = F.struct((-F.col("shared")).alias("s"), F.col("row_user").isNull().alias("null"), "row_user")
    best = found.groupBy("items").agg(F.min(order).alias("b"))
    return targets.join(best, "items").select("user_id", "b.row_user", (-F.col("b.s")).alias("shared"))


def _best_rows(targets: pa.Table, rows: pa.Table) -> pa.Table:
    """The first of the rows, by ``row_user`` with nulls last, that share most with each target; targets that share nothing are left out."""
    rows = rows.take(pc.sort_indices(rows["row_user"], null_placement="at_end"))
    lists = lambda t: t["items"].combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64()))
    asked, held = lists(targets), lists(rows)
    sizes, flat = pc.list_value_length(held).to_numpy(zero_copy_only=False), held.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    items, starts = np.unique(flat[order], return_index=True)
    owners, ends = np.repeat(np.arange(len(held)), sizes)[order], np.append(starts[1:], len(flat))
    flat = asked.flatten().to_numpy()
    at = np.searchsorted(items, flat)
    at[at == len(items)] = 0
    known = items[at] == flat if len(items) else np.zeros(len(flat), bool)
    bounds = np.append(0, np.cumsum(pc.list_value_length(asked).to_numpy(zero_copy_only=False)))
    of, best, shared = [], [], []
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        some = at[a:b][known[a:b]]
        if not len(some):
            continue
        meets = np.concatenate([owners[starts[x] : ends[x]] for x in some])
        if len(meets) * 8 < len(held):
            who, times = np.unique(meets, return_counts=True)
        else:
            who, times = None, np.bincount(meets, minlength=len(held))
        top = int(times.argmax())
        of.append(i)
        best.append(top if who is None else int(who[top]))
        shared.append(int(times[top]))
    users = rows["row_user"].combine_chunks() if rows.num_rows else pa.array([], pa.int64())
    return pa.table({"items": asked.take(pa.array(of, pa.int64())).cast(pa.list_(pa.int64())), "row_user": users.take(pa.array(best, pa.int64())), "shared": pa.array(shared, pa.int64())})


@query(
    "asof_prior",
    f"""WITH t AS ({TIMELINE}) SELECT event_id, (SELECT max_by(c.event_id, (c.ts, c.event_id)) FROM t c WHERE c.user_id = p.user_id AND c.action = 'click' AND (c.ts, c.event_id) < (p.ts, p.event_id)) AS click_id FROM t p WHERE action = 'purchase'""",
)
def asof_prior(spark, sf_dir):
    found = prior_match(timeline(spark, sf_dir), F.col("action") == "purchase", F.col("action") == "click", ["user_id"], "event_id", "click_id")
    return found.select("event_id", "click_id")


@query(
    "range_self_join",
    f"""WITH t AS ({TIMELINE}) SELECT p.event_id, count(c.event_id) AS clicks, min(c.event_id) AS first_click FROM t p LEFT JOIN t c ON c.user_id = p.user_id AND c.action = 'click' AND c.ts < p.ts AND c.ts >= p.ts - INTERVAL 6 HOUR WHERE p.action = 'purchase' GROUP BY 1""",
)
def range_self_join(spark, sf_dir):
    """Clicks of the six hours before a purchase: a range frame in one window pass instead of a self-join."""
    events = timeline(spark, sf_dir).withColumn("us", F.unix_micros("ts"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-6 * 3600 * 1_000_000, -1)
    click = F.when(F.col("action") == "click", F.col("event_id"))
    return events.select("event_id", "action", F.count(click).over(w).alias("clicks"), F.min(click).over(w).alias("first_click")).filter("action = 'purchase'").drop("action")


@query(
    "strict_future",
    f"""WITH t AS ({TIMELINE}), h AS (SELECT user_id, max(ts) AS until, list(DISTINCT item) AS seen FROM t WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
        SELECT user_id, min_by(event_id, (ts, event_id)) AS target_id FROM t JOIN h USING (user_id) WHERE ts > until + INTERVAL 12 HOUR AND NOT list_contains(seen, item) GROUP BY 1""",
)
def strict_future(spark, sf_dir):
    """The earliest event later than the history by a gap, of an item that the history lacks."""
    events = timeline(spark, sf_dir)
    history = events.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    until = history.groupBy("user_id").agg(F.max("ts").alias("until"))
    later = events.join(until, "user_id").filter(F.col("ts") > F.col("until") + F.expr("INTERVAL 12 HOURS"))
    fresh = later.join(history.select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
    return fresh.groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("target_id"))


@query(
    "ngram_candidates",
    """WITH d AS (SELECT DISTINCT doc_id, substr(text, i, 12) AS gram FROM documents, unnest(range(1, length(text) - 10)) t(i) WHERE length(text) >= 12),
       p AS (SELECT DISTINCT item_id, substr(text, i, 12) AS gram FROM benchmark, unnest(range(1, length(text) - 10)) t(i) WHERE length(text) >= 12),
       c AS (SELECT item_id, doc_id, count(*) AS shared FROM p JOIN d USING (gram) GROUP BY ALL HAVING count(*) >= 20)
       SELECT item_id, doc_id, shared, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id)::INTEGER AS rank FROM c QUALIFY rank <= 5""",
)
def ngram_candidates(spark, sf_dir):
    return gram_candidates(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), 12, 5, 20).select("item_id", "doc_id", "shared", "rank")


@query(
    "pairs_concordance",
    """WITH m AS (SELECT p_brand, avg(p_retailprice) AS x, avg(p_size) AS y FROM part GROUP BY 1)
       SELECT a.p_brand AS a, b.p_brand AS b, CASE WHEN sign(a.x - b.x) = sign(a.y - b.y) THEN 1 ELSE 0 END AS agree FROM m a JOIN m b ON a.p_brand < b.p_brand""",
)
def pairs_concordance(spark, sf_dir):
    """All pairs of a bounded set (the brands) by direction of two measures."""
    m = parts_of(spark, sf_dir).groupBy("p_brand").agg(F.avg("p_retailprice").alias("x"), F.avg("p_size").alias("y"))
    other = m.select(F.col("p_brand").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = m.withColumnRenamed("p_brand", "a").join(other, F.col("a") < F.col("b"))
    return pairs.select("a", "b", (F.signum(F.col("x") - F.col("x2")) == F.signum(F.col("y") - F.col("y2"))).cast("int").alias("agree"))


@query(
    "paired_delta",
    """WITH a AS (SELECT l_partkey, avg(l_discount) AS base FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey, avg(l_discount) AS cand FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
       SELECT l_partkey, round(cand - base, 6) + 0.0 AS delta, CASE WHEN cand > base THEN 'gain' WHEN cand < base THEN 'loss' ELSE 'same' END AS kind FROM a JOIN b USING (l_partkey)""",
)
def paired_delta(spark, sf_dir):
    """Two reports aligned row by row, from one scan.

    Sums run in the order of the table's rows, as the SQL's do on one thread: means that are equal on paper come
    out alike or not by the order of their addends, and so does ``kind``.
    """
    lines = table(spark, sf_dir, "lineitem", "l_partkey", "l_discount", "l_linestatus")
    lines = lines.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at")).filter("l_linestatus in ('F', 'O')")
    upto = Window.partitionBy("l_partkey", "l_linestatus").orderBy("path", "at").rowsBetween(Window.unboundedPreceding, 0)
    sums = lines.select("l_partkey", "l_linestatus", F.struct(F.row_number().over(upto).alias("n"), F.avg("l_discount").over(upto).alias("mean")).alias("s"))
    mean = lambda s: F.max(F.when(F.col("l_linestatus") == s, F.col("s")))["mean"]  # noqa: E731  that of the last row
    both = sums.groupBy("l_partkey").agg(mean("F").alias("base"), mean("O").alias("cand"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o")).filter("f > 0 and o > 0 and l_partkey is not null")
    kind = F.when(F.col("cand") > F.col("base"), "gain").when(F.col("cand") < F.col("base"), "loss").otherwise("same")
    scaled = F.round((F.col("cand") - F.col("base")) * 1e6) / 1e6  # half away from zero after scaling, as DuckDB rounds
    return both.select("l_partkey", (scaled + F.lit(0.0)).alias("delta"), kind.alias("kind"))


@query(
    "gold_rank",
    """WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS beam, max_by(l_partkey, (l_quantity, l_partkey)) AS gold FROM lineitem GROUP BY 1) SELECT l_orderkey, (list_position(beam, gold) - 1)::BIGINT AS rank FROM o""",
)
def gold_rank(spark, sf_dir):
    """0-based place of the gold item in a candidate list."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    beams = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("beam"), F.max_by("l_partkey", F.struct("l_quantity", "l_partkey")).alias("gold"))
    return beams.select("l_orderkey", (F.array_position("beam", F.col("gold")) - 1).alias("rank"))


@query(
    "prefix_anti",
    """WITH c AS (SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS a, p_size AS b FROM part), gate AS (SELECT DISTINCT a, b FROM c WHERE p_partkey % 50 = 0)
       SELECT p_partkey FROM c WHERE NOT EXISTS (SELECT 1 FROM gate WHERE gate.a = c.a AND gate.b = c.b)""",
)
def prefix_anti(spark, sf_dir):
    """Rows clean of a gate: neither a full id nor an (a, b) prefix of it; a full id implies its prefix."""
    codes = parts_of(spark, sf_dir).select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("a"), F.col("p_size").alias("b"))
    gate = codes.filter("p_partkey % 50 = 0").select("a", "b").distinct()
    return codes.join(gate, ["a", "b"], "left_anti").select("p_partkey")


def weighted_overlap(a: Column, b: Column, weights: Column) -> Column:
    """Share of ``a``'s weight that ``b`` also holds; ``weights`` is a map."""
    total = array_total(F.transform(a, lambda x: F.coalesce(F.try_element_at(weights, x), F.lit(0.0))))
    held = array_total(F.transform(F.array_intersect(a, b), lambda x: F.coalesce(F.try_element_at(weights, x), F.lit(0.0))))
    return ratio(held, total)

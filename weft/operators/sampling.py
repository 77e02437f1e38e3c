"""Sampling, quotas, splits and assembly; every order is a hash rank, so results do not depend on input order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.functions.expr import hash_rank, hash_rank_sql, r6, rank_unit
from weft.registry import query
from weft.sources.tables import table


def hash_sample(df: DataFrame, namespace: str, key: str, n: int) -> DataFrame:
    """n rows of lowest hash rank: a top-n by heap in each task, then over tasks."""
    return df.orderBy(hash_rank(namespace, key), key).limit(n)


def per_group(df: DataFrame, by: list[str], order: list[Column | str], limit: Column | int) -> DataFrame:
    """The first rows of each group; ``limit`` may depend on the row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def largest_remainder(sizes: DataFrame, size: str, key: str, seats: int) -> DataFrame:
    """Seats by share: the floor, then one each by largest remainder (ties by key).  One row per group."""
    every = Window.partitionBy()
    exact = F.col(size) * F.lit(seats) / F.sum(size).over(every)
    base = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.lit(seats) - F.sum("_floor").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), key))
    return base.withColumn("seats", F.col("_floor") + (rank <= left).cast("long")).drop("_exact", "_floor")


def proportional_take(df: DataFrame, by: str, key: str, namespace: str, total: int) -> DataFrame:
    """A stratified sample whose strata get their share of ``total``."""
    seats = largest_remainder(df.groupBy(by).agg(F.count("*").alias("n")), "n", by, total).select(by, "seats")
    joined = df.join(seats, by)
    return per_group(joined, [by], [hash_rank(namespace, key), F.col(key)], F.col("seats")).drop("seats")


def repeat_to(df: DataFrame, by: str, key: str, namespace: str, target: int) -> DataFrame:
    """Each group repeated, in hash order, until it has ``target`` rows; larger groups are cut."""
    sizes = df.groupBy(by).agg(F.count("*").alias("_n"))
    copies = df.join(sizes, by).withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(target) / F.col("_n")).cast("int") - 1)))
    return per_group(copies, [by], [F.col("copy"), hash_rank(namespace, key), F.col(key)], target).drop("_n")


def weighted_key(namespace: str, key: str, weight: Column) -> Column:
    """Efraimidis-Spirakis: the smallest of these keys are a sample without replacement by weight."""
    return -F.log(rank_unit(hash_rank(namespace, key))) / weight


def group_split(df: DataFrame, group: str, namespace: str, holdout: int, cap: int, row: str) -> DataFrame:
    """Whole groups to holdout, in hash order, until ``holdout`` rows are reached; at most ``cap`` rows of each group.

    The running sum is over one row per group.
    """
    kept = per_group(df, [group], [hash_rank(namespace, row), F.col(row)], cap)
    sizes = kept.groupBy(group).agg(F.count("*").alias("_n"))
    w = Window.partitionBy().orderBy(hash_rank(namespace, group), group).rowsBetween(Window.unboundedPreceding, 0)
    sides = sizes.withColumn("split", F.when(F.sum("_n").over(w) - F.col("_n") < holdout, "holdout").otherwise("train")).drop("_n")
    return kept.join(sides, group)


def exact_sum_groups(sizes: DataFrame, key: str, size: str, namespace: str, target: int) -> DataFrame:
    """Whole groups whose sizes sum exactly to the target, preferring low hash ranks; none if impossible.

    Subset sums need all groups together: the input is one row per group, in one task; state is at most
    ``target`` + 1 sums.  Groups beyond the first ``target`` of each size can never be needed and are dropped
    before.
    """
    w = Window.partitionBy(size).orderBy("_h", key)
    ranked = sizes.filter(F.col(size).between(1, target)).withColumn("_h", hash_rank(namespace, key))
    ranked = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") * F.col(size) <= target).drop("_r")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True)
        parent: dict[int, tuple[int, int]] = {0: (-1, -1)}
        for i, n in enumerate(rows[size]):
            for s in sorted(parent, reverse=True):
                if s + n <= target and s + n not in parent:
                    parent[s + n] = (s, i)
            if target in parent:
                break
        chosen, at = [], target
        while at in parent and parent[at][1] >= 0:
            at, i = parent[at]
            chosen.append(i)
        yield rows.iloc[sorted(chosen)]

    return ranked.orderBy("_h", key).coalesce(1).mapInPandas(choose, ranked.schema).select(*sizes.columns)


def docs(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "source", "lang", "n_chars")))


@query("multi_key_topn", "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, source DESC, doc_id LIMIT 20")
def multi_key_topn(spark, sf_dir):
    return docs(spark, sf_dir, "doc_id", "source", "n_chars").orderBy(F.desc("n_chars"), F.desc("source"), "doc_id").limit(20)


@query("topk", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def topk(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("hash_sample", f"SELECT doc_id FROM documents ORDER BY {hash_rank_sql('sample', 'doc_id')}, doc_id LIMIT 50")
def hash_sample_query(spark, sf_dir):
    return hash_sample(docs(spark, sf_dir, "doc_id"), "sample", "doc_id", 50)


@query(
    "strat_quota_sample",
    f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hash_rank_sql('quota', 'doc_id')}, doc_id) AS r FROM documents) SELECT lang, count(*) FILTER (WHERE r <= 60) AS taken, 60 - count(*) FILTER (WHERE r <= 60) AS shortfall, min(doc_id) FILTER (WHERE r <= 60) AS first_id, sum(doc_id) FILTER (WHERE r <= 60)::BIGINT AS id_sum FROM r GROUP BY 1""",
)
def strat_quota_sample(spark, sf_dir):
    taken = per_group(docs(spark, sf_dir), ["lang"], [hash_rank("quota", "doc_id"), F.col("doc_id")], 60)
    return taken.groupBy("lang").agg(F.count("*").alias("taken"), (F.lit(60) - F.count("*")).alias("shortfall"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("id_sum"))


_SEATS = """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, n * 77 / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x)::BIGINT AS base FROM e),
    s AS (SELECT source, n, base + CASE WHEN row_number() OVER (ORDER BY round(x - base, 9) DESC, source) <= 77 - sum(base) OVER () THEN 1 ELSE 0 END AS seats FROM f)"""


@query("largest_remainder", f"{_SEATS} SELECT source, n, seats::BIGINT AS seats FROM s")
def largest_remainder_query(spark, sf_dir):
    return largest_remainder(docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n")), "n", "source", 77)


@query("strat_take", f"{_SEATS} SELECT doc_id, source FROM documents JOIN s USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY {hash_rank_sql('take', 'doc_id')}, doc_id) <= seats")
def strat_take(spark, sf_dir):
    return proportional_take(docs(spark, sf_dir, "doc_id", "source"), "source", "doc_id", "take", 77).select("doc_id", "source")


@query(
    "group_split",
    f"""WITH k AS (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY {hash_rank_sql('gs', 'turn')}, turn) <= 4), n AS (SELECT conv_id, count(*) AS n FROM k GROUP BY 1),
        s AS (SELECT conv_id, CASE WHEN sum(n) OVER (ORDER BY {hash_rank_sql('gs', 'conv_id')}, conv_id ROWS UNBOUNDED PRECEDING) - n < 40 THEN 'holdout' ELSE 'train' END AS split FROM n) SELECT conv_id, turn, split FROM k JOIN s USING (conv_id)""",
)
def group_split_query(spark, sf_dir):
    return group_split(table(spark, sf_dir, "conversations", "conv_id", "turn"), "conv_id", "gs", 40, 4, "turn").select("conv_id", "turn", "split")


@query("reservoir_per_key", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {hash_rank_sql('res', 'event_id')}, event_id) <= 3")
def reservoir_per_key(spark, sf_dir):
    """k uniform rows of each key, as the k lowest hash ranks."""
    return per_group(table(spark, sf_dir, "events", "user_id", "event_id"), ["user_id"], [hash_rank("res", "event_id"), F.col("event_id")], 3)


@query("sample_frac", f"SELECT doc_id FROM documents WHERE {hash_rank_sql('frac', 'doc_id')} < {(1 << 60) // 10}")
def sample_frac(spark, sf_dir):
    """Each row on its own with probability 0.1, as the tenth of lowest hash ranks: the same rows whatever the partitioning."""
    return docs(spark, sf_dir, "doc_id").filter(hash_rank("frac", "doc_id") < (1 << 60) // 10)


@query("weighted_sample", f"SELECT p_partkey, round(-ln(({hash_rank_sql('ws', 'p_partkey')} + 1.0) / 1152921504606846977.0) / p_size, 6) AS k FROM part ORDER BY k, p_partkey LIMIT 30")
def weighted_sample(spark, sf_dir):
    keyed = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", r6(weighted_key("ws", "p_partkey", F.col("p_size"))).alias("k"))
    return keyed.orderBy("k", "p_partkey").limit(30)


@query(
    "rebalance",
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM documents), c AS (SELECT doc_id, lang, unnest(range(ceil(100.0 / n)::BIGINT)) AS copy FROM n) SELECT doc_id, lang, copy::INTEGER AS copy FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY copy, {hash_rank_sql('bal', 'doc_id')}, doc_id) <= 100""",
)
def rebalance(spark, sf_dir):
    return repeat_to(docs(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id", "bal", 100).select("doc_id", "lang", "copy")


@query(
    "balanced_cycle",
    f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM documents), c AS (SELECT doc_id, source, unnest(range(ceil(25.0 / n)::BIGINT)) AS copy FROM n),
        t AS (SELECT doc_id, source FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY copy, {hash_rank_sql('cyc', 'doc_id')}, doc_id) <= 25) SELECT source, count(*) AS n, count(DISTINCT doc_id) AS n_distinct, max(k) - min(k) AS spread FROM (SELECT *, count(*) OVER (PARTITION BY source, doc_id) AS k FROM t) GROUP BY 1""",
)
def balanced_cycle(spark, sf_dir):
    """Repeats of a cycled source differ by at most one; every source is covered."""
    cycled = repeat_to(docs(spark, sf_dir, "doc_id", "source"), "source", "doc_id", "cyc", 25).groupBy("source", "doc_id").agg(F.count("*").alias("k"))
    return cycled.groupBy("source").agg(F.sum("k").alias("n"), F.count("*").alias("n_distinct"), (F.max("k") - F.min("k")).alias("spread"))


@query("hash_shuffle", f"SELECT doc_id, {hash_rank_sql('shuffle', 'doc_id')} AS place FROM documents")
def hash_shuffle(spark, sf_dir):
    """The order of a seeded shuffle as a column: sort by it where an order is needed."""
    return docs(spark, sf_dir, "doc_id").select("doc_id", hash_rank("shuffle", "doc_id").alias("place"))


@query("representative", f"SELECT md5(text) AS h, arg_min(doc_id, ({hash_rank_sql('rep', 'doc_id')}, doc_id)) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def representative(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", F.md5("text").alias("h")).groupBy("h").agg(F.min_by("doc_id", F.struct(hash_rank("rep", "doc_id"), "doc_id")).alias("doc_id"), F.count("*").alias("n"))


@query(
    "swap_assembly",
    f"""WITH old AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0), gone AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY lang = 'en' DESC, {hash_rank_sql('out', 'doc_id')}, doc_id LIMIT 30), fresh AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 1 ORDER BY {hash_rank_sql('in', 'doc_id')}, doc_id LIMIT 30)
        SELECT doc_id, 'kept' AS origin FROM old WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT doc_id, 'new' FROM fresh""",
)
def swap_assembly(spark, sf_dir):
    """N rows out by policy, N in."""
    rows = docs(spark, sf_dir, "doc_id", "lang")
    old = rows.filter("doc_id % 2 = 0")
    gone = old.orderBy(F.desc(F.col("lang") == "en"), hash_rank("out", "doc_id"), "doc_id").limit(30).select("doc_id")
    fresh = hash_sample(rows.filter("doc_id % 2 = 1").select("doc_id"), "in", "doc_id", 30)
    return old.join(gone, "doc_id", "left_anti").select("doc_id", F.lit("kept").alias("origin")).unionByName(fresh.withColumn("origin", F.lit("new")))


@query("exact_sum_groups")
def exact_sum_groups_query(spark, sf_dir):
    sizes = table(spark, sf_dir, "conversations", "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))
    return exact_sum_groups(sizes, "conv_id", "n", "sum", 50)


@query("compress_group", f"SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {hash_rank_sql('long', 'doc_id')}, doc_id) = 1 THEN text ELSE substr(text, 1, 40) END AS text FROM documents")
def compress_group(spark, sf_dir):
    """One member of a group keeps the long form, the others get the short one."""
    rows = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    chosen = rows.groupBy("source").agg(F.min_by("doc_id", F.struct(hash_rank("long", "doc_id"), "doc_id")).alias("chosen"))
    return rows.join(chosen, "source").select("doc_id", "source", F.when(F.col("doc_id") == F.col("chosen"), F.col("text")).otherwise(F.substring("text", 1, 40)).alias("text"))


_SEL = f"(SELECT p_partkey FROM part ORDER BY {hash_rank_sql('slot', 'p_partkey')}, p_partkey LIMIT 40)"


@query(
    "slot_fill",
    f"""WITH sel AS {_SEL}, slots AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_partkey AS slot FROM (SELECT p_partkey FROM part WHERE p_partkey < 40) WHERE p_partkey NOT IN (SELECT * FROM sel)),
        movers AS (SELECT row_number() OVER (ORDER BY p_partkey) AS r, p_partkey FROM sel WHERE p_partkey >= 40) SELECT p_partkey AS slot, p_partkey FROM sel WHERE p_partkey < 40 UNION ALL SELECT slot, p_partkey FROM slots JOIN movers USING (r)""",
)
def slot_fill(spark, sf_dir):
    """Selected rows that are in place stay; the others fill the open places in order (40 places)."""
    parts = table(spark, sf_dir, "part", "p_partkey")
    chosen = hash_sample(parts, "slot", "p_partkey", 40)
    number = F.row_number().over(Window.partitionBy().orderBy("p_partkey"))
    open_ = parts.filter("p_partkey < 40").join(chosen, "p_partkey", "left_anti").select(number.alias("r"), F.col("p_partkey").alias("slot"))
    movers = chosen.filter("p_partkey >= 40").select(number.alias("r"), "p_partkey")
    return chosen.filter("p_partkey < 40").select(F.col("p_partkey").alias("slot"), "p_partkey").unionByName(open_.join(movers, "r").select("slot", "p_partkey"))


@query(
    "namespaced_split",
    f"""WITH prior AS (SELECT doc_id FROM labels WHERE quality = 0), p AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT * FROM prior)), gate AS (SELECT doc_id FROM p ORDER BY {hash_rank_sql('gate', 'doc_id')}, doc_id LIMIT 25), train AS (SELECT doc_id FROM p WHERE doc_id NOT IN (SELECT * FROM gate) ORDER BY {hash_rank_sql('train', 'doc_id')}, doc_id LIMIT 75)
        SELECT doc_id, 'gate' AS split FROM gate UNION ALL SELECT doc_id, 'train' FROM train""",
)
def namespaced_split(spark, sf_dir):
    pool = docs(spark, sf_dir, "doc_id").join(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_anti")
    gate = hash_sample(pool, "gate", "doc_id", 25)
    train = hash_sample(pool.join(gate, "doc_id", "left_anti"), "train", "doc_id", 75)
    return gate.withColumn("split", F.lit("gate")).unionByName(train.withColumn("split", F.lit("train")))


@query("topn_unique", "WITH k AS (SELECT p_name, min_by(p_partkey, (-p_retailprice, p_partkey)) AS p_partkey, max(p_retailprice) AS price FROM part WHERE p_type <> 'SMALL' GROUP BY 1) SELECT p_partkey, p_name, price FROM k ORDER BY price DESC, p_partkey LIMIT 20")
def topn_unique(spark, sf_dir):
    """Top rows by score with one row per key and forbidden rows left out."""
    allowed = table(spark, sf_dir, "part").filter("p_type <> 'SMALL'")
    best = allowed.groupBy("p_name").agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey")).alias("p_partkey"), F.max("p_retailprice").alias("price"))
    return best.orderBy(F.desc("price"), "p_partkey").limit(20).select("p_partkey", "p_name", "price")


_STRATA = ("ECONOMY", "SMALL", "STANDARD")


def quota_unique(df: DataFrame, stratum: str, key: str, row: str, strata: tuple[str, ...], quota: int, namespace: str) -> DataFrame:
    """Strata filled in order by hash rank, each key used once over all strata."""
    out = None
    for name in strata:  # a short list of the configuration
        pool = df.filter(F.col(stratum) == name)
        if out is not None:
            pool = pool.join(out.select(key), key, "left_anti")
        best = pool.groupBy(key).agg(F.min_by(F.struct(stratum, row), F.struct(hash_rank(namespace, row), row)).alias("b")).select(key, "b.*")
        chosen = hash_sample(best, namespace, row, quota)
        out = chosen if out is None else out.unionByName(chosen)
    return out


_Q = "SELECT p_name, arg_min(p_partkey, ({h}, p_partkey)) AS p_partkey FROM part WHERE p_type = '{t}'{w} GROUP BY 1 ORDER BY min(({h}, p_partkey)) LIMIT 8"
_H = hash_rank_sql("uq", "p_partkey")


@query(
    "quota_unique_keys",
    f"""WITH a AS ({_Q.format(h=_H, t='ECONOMY', w='')}), b AS ({_Q.format(h=_H, t='SMALL', w=' AND p_name NOT IN (SELECT p_name FROM a)')}), c AS ({_Q.format(h=_H, t='STANDARD', w=' AND p_name NOT IN (SELECT p_name FROM a) AND p_name NOT IN (SELECT p_name FROM b)')})
        SELECT 'ECONOMY' AS p_type, * FROM a UNION ALL SELECT 'SMALL', * FROM b UNION ALL SELECT 'STANDARD', * FROM c""",
)
def quota_unique_keys(spark, sf_dir):
    return quota_unique(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type"), "p_type", "p_name", "p_partkey", _STRATA, 8, "uq").select("p_type", "p_name", "p_partkey")


# set operations


@query("union_all", "SELECT doc_id AS id, 'doc' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def union_all(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind")).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("intersect", "SELECT p_partkey AS k FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def intersect(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).intersect(table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_partkey"))


@query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("split_disjoint", f"WITH s AS (SELECT text, CASE WHEN {hash_rank_sql('dj', 'doc_id')} % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents) SELECT count(*) AS keys, count(*) FILTER (WHERE k > 1) AS leaking FROM (SELECT text, count(DISTINCT split) AS k FROM s GROUP BY 1)")
def split_disjoint(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", F.sha2("text", 256).alias("h"), F.when(hash_rank("dj", "doc_id") % 5 == 0, "dev").otherwise("train").alias("split"))
    return rows.groupBy("h").agg(F.countDistinct("split").alias("k")).agg(F.count("*").alias("keys"), F.count(F.when(F.col("k") > 1, 1)).alias("leaking"))


@query("multiset_overlap", "WITH a AS (SELECT o_custkey % 25 AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_suppkey % 25 AS k, count(*) AS m FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT sum(least(n, m))::BIGINT AS shared FROM a JOIN b USING (k)")
def multiset_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25).alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").groupBy((F.col("l_suppkey") % 25).alias("k")).agg(F.count("*").alias("m"))
    return a.join(b, "k").agg(F.sum(F.least("n", "m")).alias("shared"))

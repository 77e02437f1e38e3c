"""Temperature mixing of sources, with DataFrame functions only.

A source of token share q gets the weight q^a / sum(q^a).  The exponent a in [0, 1] is bisected: it is
the largest whose weights' entropy reaches ``entropy`` times the logarithm of the number of sources,
raised where needed to the smallest at which no source is repeated more than ``repeats`` times.  The
weights times the budget are each source's tokens: whole blocks, each a permutation of all its
documents, and of the last block as many documents, in that block's order, as the budget holds.

The cut of the last block is found without sorting a source: its documents fall into cells by their
permutation key, cells are summed before the shuffle, and only the cell in which the budget ends is
ordered.  Per-source tables are broadcast up to a checked number of sources and joined by key beyond.

Edge cases: a null text has no token; a null source counts as the source ''; documents without a
token weigh nothing but come along in the blocks in which their place in the order lies; sources
without a token get weight 0 and no rows; one source gets weight 1; rows repeated with one doc_id are
taken or left together; a null doc_id is ordered as ''; an empty table gives an empty result; other
columns, whatever their names, are kept, and the added columns replace columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm._scratch import drop, stored, unused, with_key_table

ENTROPY, REPEATS, SEED = 0.97, 4.0, 17
#: Bisection steps, and how many of them one pass over the sources evaluates.
STEPS, AT_ONCE = 40, 5
#: Documents that a cell holds on average.
CELL_ROWS = 10_000
KEY_BITS = 60
WORD = "[^ \\t\\n\\r\\f]+"
ADDED = ("block", "mix_order", "weight")


def permutation_key(block: Column, doc_id: Column, seed: int) -> Column:
    """A number below 2^60 for a document in a block."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), block.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def exponent(shares: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """The exponent for ``shares`` (columns q and n, the tokens); bisected AT_ONCE steps a pass."""
    n = shares.count()
    if n < 2:
        return 1.0
    goal = entropy * math.log(n)

    def measured(at: list[float]) -> list[tuple[float, float]]:
        each = shares.select("q", "n", F.explode(F.array(*[F.lit(a) for a in at])).alias("a")).withColumn("w", F.exp(F.col("a") * F.log("q")))
        sums = each.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("q")).alias("s"), F.max(F.col("w") / F.col("n")).alias("r"))
        got = {r.a: (math.log(r.z) - r.a * r.s / r.z, budget * r.r / r.z) for r in sums.collect()}  # AT_ONCE**2 rows
        return [got[a] for a in at]

    def bisect(low: float, high: float, left) -> float:
        """The place at which ``left`` turns from true to false, to STEPS halvings."""
        for _ in range(STEPS // AT_ONCE):
            parts = 1 << AT_ONCE
            at = [low + (high - low) * i / parts for i in range(1, parts)]
            good = sum(map(left, measured(at)))  # true up to a place, false beyond
            low, high = ([low, *at])[good], ([*at, high])[good]
        return (low + high) / 2

    (most, worst), (least, best) = measured([0.0, 1.0])
    flat = 1.0 if least >= goal else 0.0 if most <= goal else bisect(0.0, 1.0, lambda m: m[0] >= goal)
    held = 0.0 if worst <= repeats else 1.0 if best >= repeats else bisect(0.0, 1.0, lambda m: m[1] > repeats)
    return max(flat, held)


def mix(docs: DataFrame, text: str = "text", source: str = "source", budget: float | None = None, entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = SEED) -> DataFrame:
    """``docs``, one row per realised copy, with ``block``, ``mix_order`` and ``weight``.

    ``budget`` is in tokens (runs of non-spaces), by default as many as there are.  Sorted by ``mix_order``
    (0 to about 1) the sources are interleaved at their weights.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    slim = stored(docs.select("doc_id", F.coalesce(F.col(source), F.lit("")).alias("_source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_n")), "slim")
    sources = stored(slim.groupBy("_source").agg(F.sum("_n").alias("n"), F.count("*").alias("docs")).filter("n > 0"), "sources")
    total = sources.agg(F.sum("n")).first()[0]
    if total is None:
        drop(slim)
        return docs.limit(0).select(*kept, F.lit(0).cast("int").alias("block"), F.lit(0.0).alias("mix_order"), F.lit(0.0).alias("weight"))
    wanted = float(total if budget is None else budget)
    shares = sources.withColumn("q", F.col("n") / F.lit(float(total)))
    a = exponent(shares, entropy, repeats, wanted)
    weighted = shares.withColumn("w", F.exp(F.lit(a) * F.log("q")))
    z = weighted.agg(F.sum("w")).first()[0]
    plan = weighted.select("_source", (F.col("w") / F.lit(z)).alias("weight"), "n", F.greatest(F.lit(1), F.ceil(F.col("docs") / CELL_ROWS)).alias("cells"), F.floor(F.lit(wanted) * F.col("w") / F.lit(z) + F.lit(0.001)).cast("long").alias("goal"))
    plan = stored(plan.withColumn("full", F.expr("goal div n")).withColumn("rest", F.expr("goal % n")), "plan")

    def placed(rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows with their source's plan, and their key and cell in the source's last block."""
        out = with_key_table(rows, table, "_source").filter(F.col("full").isNotNull())
        out = out.withColumn("_key", permutation_key(F.col("full"), F.col("doc_id"), seed))
        return out.withColumn("_cell", F.shiftright(F.shiftright("_key", 30) * F.col("cells"), 30))

    rows = placed(slim, plan)
    sums = rows.groupBy("_source", "_cell", "rest").agg(F.sum("_n").alias("s"))
    upto = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("_source").orderBy("_cell")))
    end = upto.filter("upto > rest").groupBy("_source").agg(F.min("_cell").alias("end_cell"), (F.min_by(F.col("upto") - F.col("s"), "_cell")).alias("before"))
    ended = stored(plan.join(end, "_source"), "ends")
    inside = placed(slim, ended).filter("_cell = end_cell")
    order = Window.partitionBy("_source").orderBy("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  # the rows of one cell; peers count together
    taken = inside.withColumn("upto", F.col("before") + F.sum("_n").over(order)).filter("upto <= rest")
    last = taken.groupBy("_source").agg(F.max(F.struct("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))).alias("last"))
    cut = stored(ended.join(last, "_source", "left"), "cut")
    for old in (slim, sources, plan, ended):
        drop(old)
    # the plan's columns ride along under names that no column of docs has
    plain = ["_source", "full", "cells", "end_cell", "last", "n", "goal", "weight", "copies", "key", "cell"]
    own = dict(zip(plain, unused(docs, *plain), strict=True))
    keys = cut.select(*[F.col(c).alias(own[c]) for c in plain[:8]])
    out = with_key_table(docs.select(*kept).withColumn(own["_source"], F.coalesce(F.col(source), F.lit(""))), keys, own["_source"])
    col = {c: F.col(own[c]) for c in plain}
    out = out.filter(col["full"].isNotNull()).withColumn(own["key"], permutation_key(col["full"], F.col("doc_id"), seed))
    out = out.withColumn(own["cell"], F.shiftright(F.shiftright(own["key"], 30) * col["cells"], 30))
    place = F.struct(col["key"].alias("_key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))
    more = (col["cell"] < col["end_cell"]) | ((col["cell"] == col["end_cell"]) & F.coalesce(place <= col["last"], F.lit(False)))
    out = out.withColumn(own["copies"], col["full"] + more.cast("long")).filter(col["copies"] > 0)
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0), (col["copies"] - 1).cast("int"))))
    u = permutation_key(F.col("block"), F.col("doc_id"), seed) / F.lit(float(1 << KEY_BITS))
    order = F.round((F.col("block") + u) * col["n"] / col["goal"], 6)
    return out.select(*kept, "block", order.alias("mix_order"), F.round(col["weight"], 6).alias("weight"))


def oracle(entropy: float = ENTROPY, repeats: float = REPEATS, seed: int = SEED) -> str:
    """The rows ``doc_id, source, block, mix_order, weight`` of ``mix`` over ``documents``, in DuckDB's SQL."""
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS n FROM t GROUP BY source HAVING sum(n) > 0),
tot AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k FROM s),
q AS (SELECT source, n, n / total AS q, total, k FROM s, tot),
ends AS (SELECT a, ln(sum(w)) - a * sum(w * ln(q)) / sum(w) AS h, max(total * w / n) / sum(w) AS r, any_value(k) AS k
         FROM (SELECT a, q, n, total, k, exp(a * ln(q)) AS w FROM q, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(a)) GROUP BY a),
flat(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN g THEN mid ELSE low END, CASE WHEN g THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
          (SELECT ln(sum(exp((f.low + f.high) / 2 * ln(q)))) - (f.low + f.high) / 2 * sum(exp((f.low + f.high) / 2 * ln(q)) * ln(q)) / sum(exp((f.low + f.high) / 2 * ln(q))) >= {entropy} * ln(any_value(k)) FROM q) AS g
        FROM flat f WHERE i < {STEPS})),
held(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN g THEN mid ELSE low END, CASE WHEN g THEN high ELSE mid END
  FROM (SELECT i, low, high, (low + high) / 2 AS mid,
          (SELECT max(total * exp((f.low + f.high) / 2 * ln(q)) / n) / sum(exp((f.low + f.high) / 2 * ln(q))) > {repeats} FROM q) AS g
        FROM held f WHERE i < {STEPS})),
a AS (SELECT CASE WHEN (SELECT k FROM tot) < 2 THEN 1.0 ELSE greatest(
    CASE WHEN (SELECT h >= {entropy} * ln(k) FROM ends WHERE a = 1) THEN 1.0 WHEN (SELECT h <= {entropy} * ln(k) FROM ends WHERE a = 0) THEN 0.0 ELSE (SELECT (low + high) / 2 FROM flat WHERE i = {STEPS}) END,
    CASE WHEN (SELECT r <= {repeats} FROM ends WHERE a = 0) THEN 0.0 WHEN (SELECT r >= {repeats} FROM ends WHERE a = 1) THEN 1.0 ELSE (SELECT (low + high) / 2 FROM held WHERE i = {STEPS}) END) END AS a),
w AS (SELECT source, n, total, exp(a * ln(q)) / sum(exp(a * ln(q))) OVER () AS weight FROM q, a),
p AS (SELECT source, n, weight, floor(total * weight + 0.001)::BIGINT AS goal, floor(total * weight + 0.001)::BIGINT // n AS full, floor(total * weight + 0.001)::BIGINT % n AS rest FROM w),
c AS (SELECT t.doc_id, t.source, p.weight, p.goal, p.n AS of_source, p.full,
        p.full + (sum(t.n) OVER (PARTITION BY t.source ORDER BY ('0x' || substr(md5(t.doc_id || ':' || p.full || ':{seed}'), 1, 15))::BIGINT, t.doc_id::VARCHAR) <= p.rest)::BIGINT AS copies
      FROM t JOIN p USING (source)),
b AS (SELECT *, unnest(range(copies)) AS block FROM c)
SELECT doc_id, source, block::INTEGER AS block, round((block + ('0x' || substr(md5(doc_id || ':' || block || ':{seed}'), 1, 15))::BIGINT / {float(1 << KEY_BITS)!r}) * of_source / goal, 6) AS mix_order, round(weight, 6) AS weight
FROM b
"""

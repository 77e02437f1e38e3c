"""Flagship plan: leakage-safe user-sequence build over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.registry import query
from weft.sources.tables import table

TAIL = 20
QUOTA = 50

ORACLE = f"""
WITH e AS (
  SELECT user_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events),
target AS (SELECT user_id, event_id AS target_id, event_type AS target_type, ts AS target_ts FROM e WHERE rn = 1),
hist AS (
  SELECT e.user_id, count(*) AS n_history, count(DISTINCT e.event_type) AS n_types, max(e.ts) AS history_max_ts
  FROM e WHERE rn BETWEEN 2 AND {TAIL + 1} GROUP BY e.user_id),
kept AS (
  SELECT t.user_id, t.target_id, t.target_type, h.n_history, h.n_types,
         CASE WHEN ('0x' || substr(sha256('split:' || t.user_id), 1, 15))::BIGINT % 10 = 0 THEN 'holdout' ELSE 'train' END AS split,
         ('0x' || substr(sha256('rank:' || t.user_id), 1, 15))::BIGINT AS h
  FROM target t JOIN hist h USING (user_id) WHERE t.target_ts > h.history_max_ts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split, target_type ORDER BY h, user_id) AS r FROM kept)
SELECT user_id, target_id, target_type, n_history, n_types, split FROM ranked WHERE r <= {QUOTA}
"""


@query("flagship_user_sequences", ORACLE)
def user_sequence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event as target, the previous ``TAIL`` as history, strict-future filter, hash split, quota per stratum."""
    events = table(spark, sf_dir, "events", "user_id", "event_id", "ts", "event_type")
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = events.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= TAIL + 1)
    past = F.col("rn") > 1
    users = recent.groupBy("user_id").agg(
        F.max(F.when(~past, F.col("event_id"))).alias("target_id"),
        F.max(F.when(~past, F.col("event_type"))).alias("target_type"),
        F.max(F.when(~past, F.col("ts"))).alias("target_ts"),
        F.count(F.when(past, 1)).alias("n_history"),
        F.countDistinct(F.when(past, F.col("event_type"))).alias("n_types"),
        F.max(F.when(past, F.col("ts"))).alias("history_max_ts"),
    )
    bucket = lambda name: F.conv(F.substring(F.sha2(F.concat(F.lit(name + ":"), F.col("user_id").cast("string")), 256), 1, 15), 16, 10).cast("long")
    kept = (
        users.filter(F.col("target_ts") > F.col("history_max_ts"))
        .withColumn("split", F.when(bucket("split") % 10 == 0, "holdout").otherwise("train"))
        .withColumn("h", bucket("rank"))
    )
    stratum = Window.partitionBy("split", "target_type").orderBy("h", "user_id")
    return (
        kept.withColumn("r", F.row_number().over(stratum))
        .filter(F.col("r") <= QUOTA)
        .select("user_id", "target_id", "target_type", "n_history", "n_types", "split")
    )

"""Streaming operators, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.functions.expr import r6
from weft.registry import query
from weft.sources.tables import table


def stream_of(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A file stream of a Parquet table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; ``late`` is a stream's watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if late else timed
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, key: list[str], late: str | None = None) -> DataFrame:
    """One row per key: by state within the watermark in a stream, the earliest in a batch."""
    if events.isStreaming:
        return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "1 day").dropDuplicatesWithinWatermark(key)
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r")).select(*key, "r.*")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def running_totals(events: DataFrame) -> DataFrame:
    """Custom state: each user's event count and last type, updated as batches arrive."""

    def update(key, frames: Iterator[pd.DataFrame], state):
        n, last = state.get if state.exists else (0, "")
        for frame in frames:
            frame = frame.sort_values(["ts", "event_id"])
            n += len(frame)
            last = frame["event_type"].iloc[-1]
        state.update((n, last))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_type": [last]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_type string", "n long, last_type string", "update", "NoTimeout")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet, exactly once by its checkpoint, and stops when all is read."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


@query("tumbling_window", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    counted = tumbling(_events(spark, sf_dir), "6 hours")
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "session_window",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
       SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, id""",
)
def session_window(spark, sf_dir):
    found = sessions(_events(spark, sf_dir), "30 minutes")
    return found.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("dedupe_seen", "SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedupe_seen(spark, sf_dir):
    return first_seen(_events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_antijoin(spark, sf_dir):
    return resume(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@F.udtf(returnType="place int, gram string")
class WordPairs:
    """Table function: a row for each two neighbouring words of a text; none for null."""

    def eval(self, text: str):
        words = (text or "").split(" ")
        for i in range(len(words) - 1):
            yield i, f"{words[i]} {words[i + 1]}"


@query("udtf_ngrams", "SELECT p_partkey, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS grams FROM (SELECT p_partkey, str_split(p_name || ' ' || lower(p_type), ' ') AS w FROM part)")
def udtf_ngrams(spark, sf_dir):
    """Word n-grams of each row, a table function's rows gathered again per key."""
    text = F.concat_ws(" ", "p_name", F.lower("p_type")).alias("t")
    rows = table(spark, sf_dir, "part").select("p_partkey", text).lateralJoin(WordPairs(F.col("t").outer()), how="left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "gram"))))
    return rows.groupBy("p_partkey").agg(F.transform(ordered, lambda x: x["gram"]).alias("grams"))

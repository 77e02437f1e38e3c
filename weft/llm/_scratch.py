"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of one row per key is broadcast.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset, in a local session."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def stored(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends here.

    A lost executor costs a re-read of files that every node can see, never a recomputation.  With ``by``, rows of
    each value of that column lie in a folder of their own, which ``drop`` can delete alone.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out._weft_paths = [path]
    return out


def reads(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, known to read these ``stored`` tables and no others."""
    df._weft_paths = [p for t in tables for p in getattr(t, "_weft_paths", [])]
    return df


def drop(df: DataFrame, part: str = "") -> None:
    """Delete the files of ``stored`` tables that nothing reads any more, or only those of a ``part`` (column=value)."""
    for path in getattr(df, "_weft_paths", []):
        spark, path = df.sparkSession, f"{path}/{part}".rstrip("/")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    It learns of them only when the driver's garbage is collected, which a driver with little to do puts off.
    """
    gc.collect()
    spark._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made to differ from all of ``df``'s columns, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def with_key_table(rows: DataFrame, keyed: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` left-joined with ``keyed`` (one row per key, already stored and so cheap to count).

    Up to ``limit`` keys ``keyed`` is broadcast; beyond, both are dealt by key for this join alone, so that
    adaptive execution can split the rows of a key that holds a third of them.
    """
    if keyed.count() <= limit:
        return rows.join(F.broadcast(keyed), key, "left")
    return rows.join(keyed.hint("merge"), key, "left")

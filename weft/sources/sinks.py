"""Sinks: Parquet, canonical JSON lines, CSV, audit rows; all-or-nothing, never over existing output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.registry import query
from weft.sources.tables import table


def guard_paths(outputs: list[str], protected: list[str]) -> None:
    """Outputs must differ from each other and lie outside every protected folder."""
    clean = [o.rstrip("/") for o in outputs]
    if len(set(clean)) != len(clean):
        raise ValueError("outputs must be distinct")
    for o in clean:
        for p in protected:
            if o == p.rstrip("/") or o.startswith(p.rstrip("/") + "/"):
                raise ValueError(f"{o} lies inside the protected {p}")


def write_new(df: DataFrame, path: str, kind: str = "parquet", protected: list[str] | None = None, **options: str) -> None:
    """Writes ``df`` where nothing is yet; Spark's commit makes it all or nothing."""
    guard_paths([path], protected or [])
    df.write.mode("errorifexists").options(**options).format(kind).save(path)


def canonical_json(df: DataFrame) -> Column:
    """One row as JSON with sorted keys and no spaces."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_json_lines(df: DataFrame, path: str) -> None:
    write_new(df.select(canonical_json(df).alias("value")), path, "text")


def write_csv(df: DataFrame, path: str) -> None:
    write_new(df, path, "csv", header="true")


def register_dataset(df: DataFrame, name: str) -> None:
    """Makes a table known by name in the session."""
    df.createOrReplaceTempView(name)


def audit_row(df: DataFrame, key: str, total: str) -> DataFrame:
    """Counts, bounds and an order-independent hash of a table's keys, as one row.

    Sums are decimals: some 65,536 hashes of 48 bits are more than a long holds.
    """
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10)
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), exact(F.col(total)).cast("long").alias("total"), exact(digest).cast("string").alias("digest"))


def markdown_table(header: list[str], rows: list[list]) -> str:
    """A bounded result as a Markdown table; bars in cells are escaped."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


@query("to_json_canonical", "SELECT n_nationkey, json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey)::VARCHAR AS json FROM nation")
def to_json_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select("n_nationkey", canonical_json(nation).alias("json"))


@query(
    "audit_summary",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, min(o_orderkey) AS min_key, max(o_orderkey) AS max_key, sum(o_custkey)::BIGINT AS total,
       sum(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 12))::BIGINT)::VARCHAR AS digest FROM orders""",
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_row(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


_PUBLIC = "^(PROMO|STANDARD)"


@query("allowlist_filter", f"SELECT regexp_matches(p_type, '{_PUBLIC}') AS is_public, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part GROUP BY 1")
def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", "p_type")
    return part.groupBy(F.col("p_type").rlike(_PUBLIC).alias("is_public")).agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("kinds"))


@query(
    "to_json_rows",
    """SELECT conv_id, turn, '[' || json_object('system', role, 'prompt', turn::VARCHAR, 'response', length(text)::VARCHAR) || ']' AS row_json FROM conversations""",
)
def to_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows in the one-element-array form."""
    turns = table(spark, sf_dir, "conversations")
    item = F.struct(F.col("role").alias("system"), F.col("turn").cast("string").alias("prompt"), F.length("text").cast("string").alias("response"))
    return turns.select("conv_id", "turn", F.to_json(F.array(item)).alias("row_json"))

"""Runs a query's DuckDB SQL over the same Parquet tables and compares rows without regard to order."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

from weft.sources.tables import TABLES

SF_DIR = os.environ.get("WEFT_TEST_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return str(value)


def connection(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def duck_rows(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], Counter]:
    con = connection(sf_dir)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r.asDict(recursive=True)[n]) for n in names) for r in df.collect())


def difference(df, sql: str, sf_dir: str = SF_DIR) -> str:
    """Empty if names and rows agree, else what differs."""
    (a, x), (b, y) = spark_rows(df), duck_rows(sql, sf_dir)
    if a != b:
        return f"columns: {a} and {b}"
    if x == y:
        return ""
    return f"{sum(x.values())} and {sum(y.values())} rows; only in Spark {list((x - y).items())[:3]}; only in SQL {list((y - x).items())[:3]}"

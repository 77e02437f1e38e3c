"""Results that must hold on tables of many rows and of many files."""

import hashlib
import random

import duckdb
import pytest

from tests.oracle import difference
from weft.catalogue import oracles, queries
from weft.operators import joins
from weft.sources import readers, sinks


def test_audit_row_of_many_keys(spark):
    row = sinks.audit_row(spark.range(100_000).selectExpr("id", "id AS total"), "id", "total").first()
    assert row.digest == str(sum(int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) for i in range(100_000)))
    assert (row.n_rows, row.n_keys, row.total) == (100_000, 100_000, 99_999 * 50_000)
    sums = sinks.audit_row(spark.createDataFrame([(1, 2**62), (2, 2**62), (3, -(2**62))], "id long, total long"), "id", "total").first()
    assert sums.total == 2**62


def test_rows_are_numbered_over_all_files_of_a_table(spark, tmp_path):
    where = str(tmp_path / "documents.parquet")
    spark.range(100).selectExpr("id AS doc_id", "'x' AS text").repartition(5).write.parquet(where)
    assert difference(queries()["scan_rowid"](spark, str(tmp_path)), oracles()["scan_rowid"].replace("FROM documents", f"FROM '{where}/*.parquet'")) == ""
    one = str(tmp_path / "one.parquet")
    spark.range(10).write.parquet(one)
    assert [r.place for r in readers.with_table_row(spark.read.parquet(one).filter("id >= 0"), "place").orderBy("id").collect()] == list(range(10))


def test_paired_delta_sums_in_the_order_of_the_rows(spark, tmp_path):
    """Parts whose two means are equal on paper, and one without discounts, in eight files."""
    rng, where = random.Random(3), str(tmp_path / "lineitem.parquet")
    rows = [(9999, None, "F"), (9999, 0.1, "O")]
    for part in range(300):
        some = [rng.randrange(11) / 100 for _ in range(rng.randrange(3, 40))]
        rows += [(part, x, "F") for x in some] + [(part, x, "O") for x in rng.sample(some, len(some))] + [(part, 0.5, "X")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "l_partkey long, l_discount double, l_linestatus string").repartition(8).write.parquet(where)
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{where}/*.parquet'")
    sql = con.execute(oracles()["paired_delta"]).fetchall()
    assert sorted(map(tuple, queries()["paired_delta"](spark, str(tmp_path)).select("l_partkey", "delta", "kind").collect()), key=str) == sorted(sql, key=str)


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_most_shared(spark, block):
    """Against all pairs: equal sets, ties, null users, targets that share nothing, blocks of few sets."""
    rng = random.Random(block)
    some = lambda ids: [(i, sorted(rng.sample(range(12), rng.randrange(1, 5)))) for i in ids]
    targets, rows = [*some([*range(30), None]), (77, [99])], some([*range(40), None])
    rows = [(None, [50]), *rows]
    targets.append((78, [50]))
    order = lambda r, t: (-len(set(r[1]) & set(t[1])), r[0] is None, r[0] or 0)
    want = {(t[0], *min(((r[0], len(set(r[1]) & set(t[1]))) for r in [min(rows, key=lambda r: order(r, t))]))) for t in targets if any(set(r[1]) & set(t[1]) for r in rows)}
    got = joins.most_shared(spark.createDataFrame(targets, "user_id long, items array<long>"), spark.createDataFrame(rows, "row_user long, items array<long>"), block)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)


def test_overlap_argmax_makes_no_row_for_each_pair(spark, tmp_path):
    """3,000 buyers and 3,000 viewers of one item: nine million pairs, one distinct set a side."""
    events = spark.range(6000).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "if(id < 3000, 'purchase', 'view') AS event_type", "1D AS value", "'{\"k\": 7}' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = queries()["overlap_argmax"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.orderBy("user_id").collect()] == [(i, 3000, 1) for i in range(3000)]
    assert "CoGroupInArrow" in plan

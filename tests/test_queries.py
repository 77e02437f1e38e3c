"""Every registered query against its SQL, and the queries without SQL against their invariants."""

import pytest

from tests.oracle import SF_DIR, difference
from weft import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracles()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, key):
    assert difference(QUERIES[key](spark, SF_DIR), ORACLES[key], SF_DIR) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, key):
    first = sorted(map(str, QUERIES[key](spark, SF_DIR).collect()))
    assert first
    assert first == sorted(map(str, QUERIES[key](spark, SF_DIR).collect()))


def test_every_query_is_documented_by_a_module():
    assert all(fn.__module__.startswith("weft.") for fn in QUERIES.values())


def test_every_oracle_is_sql():
    assert all(type(sql) is str for sql in ORACLES.values())


def test_the_entry_point_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 200 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

"""Every query with an SQL twin, run next to DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

BUILT, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, sf, con, name):
    result = compare(BUILT[name](spark, sf), con, SQL[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).count() > 0

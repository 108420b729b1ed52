"""Every registered query with a SQL oracle equals DuckDB on the driver tables."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), con, ORACLES[name])
    assert ok, f"{name}: {msg}"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "days_since_last_visit" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(E.queries())

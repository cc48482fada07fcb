"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, small, con):
    df = entry.queries()[name](spark, small)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert {"query_id", "status", "summary", "total_votes"} <= set(df.columns)
    assert df.count() == 1000


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())

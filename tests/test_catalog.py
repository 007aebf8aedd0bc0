"""Every registered query against its oracle SQL on the same tables."""

import pytest

import __spark_entry__ as entry_point
from oracle import compare, connect
from shelfcast.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


def test_entry_point(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["id", "hp1"] and df.count() > 0
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())

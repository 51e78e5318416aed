"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small_dir, name):
    assert compare(spark, con, small_dir, QUERIES[name], ORACLES.get(name)) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Registered queries against their SQL, all of them."""

import pytest

from checks.compare import database, difference
from checks.oracles import statements
from checks.queries import queries

SQL = statements()
@pytest.fixture(scope="module")
def connection(small):
    return database(small)


def test_every_query_has_sql():
    assert set(SQL) == set(queries())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, small, connection, name):
    assert difference(queries()[name](spark, small), connection, SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(queries()) <= set(contract.oracle_sql())

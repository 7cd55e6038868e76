"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import TESTDATA

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.registry import QUERIES

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert difference(spark, FOLDER, name, connection) is None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 3
    assert driver.oracle_sql().keys() <= driver.queries().keys()
    assert driver.queries().keys() >= QUERIES.keys()

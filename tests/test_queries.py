"""Every query against its DuckDB statement."""

import pytest
from compare import database, difference
from conftest import SMALL

import __spark_entry__ as entry
from corpusloom.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_statements_belong_to_queries():
    assert set(SQL) == set(queries.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, con, name):
    found = entry.queries()[name](spark, SMALL).toPandas()
    assert difference(found, con.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

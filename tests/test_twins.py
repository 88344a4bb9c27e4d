"""Every query with a SQL twin gives the twin's rows at the smallest scale."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_twin(spark, name):
    assert len(QUERIES[name](spark, SF_DIR).toPandas().columns) > 0


def test_entry(spark):
    assert entry_point.entry(spark).columns

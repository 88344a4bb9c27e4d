"""Queries of the training-data operators give the rows of their SQL at the smallest scale."""

import pytest

from factloom.llm.queries import QUERIES, SQL
from tests.compare import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), oracle_connection(SF_DIR).execute(SQL[name]).df()) is None


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))

"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

# The library's own; optional operators have their own tests.
QUERIES, ORACLES = entry.QUERIES, entry.ORACLES
# No SQL: least squares with many terms; test_models checks the same code densely.
ROWS_ONLY = {"model_grid"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ROWS_ONLY])
def test_query(spark, con, sf, name):
    _, problem = compare(spark, con, QUERIES[name], ORACLES[name], sf)
    assert not problem, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY

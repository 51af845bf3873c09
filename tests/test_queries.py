"""Every registered query against its SQL on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.harness import compare, make_duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return make_duck(SF_DIR)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, duck, key):
    difference = compare(QUERIES[key](spark, SF_DIR), duck, ORACLES[key])
    assert difference == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    assert QUERIES[key](spark, SF_DIR).collect()


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 20

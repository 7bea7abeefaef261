"""Every registered query against its DuckDB statement on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck
from tripmart.plans import oracle, queries

QUERIES = queries.QUERIES
ORACLES = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, SF_SMALL, QUERIES, ORACLES, con)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 1 and df.columns == ["service_type", "avg_min", "avg_dist", "avg_tip", "n"]

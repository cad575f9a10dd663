import pytest
from compare import check

from tallyframe.plans import files, queries

QUERIES, ORACLES = queries.QUERIES | queries.FIXTURE_QUERIES | files.QUERIES, queries.ORACLES | files.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0

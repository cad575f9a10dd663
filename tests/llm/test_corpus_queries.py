import pytest
from compare import check

from tallyframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])

import pytest
from ledgerlake.plans.queries import ORACLE_SQL, QUERIES

from tests.oracle import compare


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 0

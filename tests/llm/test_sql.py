"""Queries that SQL can express, against DuckDB on whole tables."""

import pytest
from ledgerlake.llm.queries import ORACLE_SQL, QUERIES

from tests.oracle import compare


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    assert compare(spark, QUERIES[name], ORACLE_SQL[name]) > 100

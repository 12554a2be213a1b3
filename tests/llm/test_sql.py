"""The queries that SQL can express, against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from recordwarden.llm.sql import all_sql
from tests.oracle_check import compare, connect

from .helpers import TABLES


@pytest.mark.parametrize("name", list(all_sql()))
def test_query_equals_sql(spark, name):
    assert name in entry_points.queries()
    _, problems = compare(spark, connect(TABLES), TABLES, name)
    assert not problems

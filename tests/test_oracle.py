"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from recordwarden.catalog.oracle import all_sql
from recordwarden.catalog.queries import all_queries

from .oracle_check import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(all_queries()))
def test_query_equals_sql(spark, con, name):
    _, problems = compare(spark, con, SF_DIR, name)
    assert not problems


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1

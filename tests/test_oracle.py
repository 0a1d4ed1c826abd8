"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

from checks.compare import connect, difference
from checks.registry import ORACLE, QUERIES, flagship

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the given tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(TABLES)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, connection, name):
    assert difference(spark, connection, TABLES, name) is None


def test_flagship_is_one_row(spark):
    assert flagship(spark, TABLES).count() == 1

"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

from compare import differences, duck

import __spark_entry__ as entry
from ferryload.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(registry.registered())


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0

"""Every catalogue query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_catalogue import connect, differences

from eventrate.plans.catalogue import CATALOGUE

FOLDER = os.environ.get("EVENTRATE_TEST_FOLDER", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert differences(df, con, sql) == []
    else:
        assert df.count() > 0

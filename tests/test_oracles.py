"""Every registered query beside its SQL, and the queries without SQL for their rows."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    line = compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.endswith("ok"), line


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 15

"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name) == ""


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["voxel_id", "delta", "p"] and df.count() == 64


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query runs; those with a SQL twin give the same rows, names and types."""

import os

import pytest
from check import compare, connect

import __spark_entry__ as entry_module

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DIR)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert compare(df.columns, rows, [c[0] for c in cur.description], cur.fetchall()) is None


def test_compare_sees_a_difference():
    assert compare(["a"], [(1,)], ["a"], [(2,)])
    assert compare(["a"], [(1,)], ["b"], [(1,)])
    assert compare(["a"], [(1,)], ["a"], [(1,), (1,)])
    assert compare(["a", "b"], [(1, 2)], ["b", "a"], [(2, 1)]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "turn_rms_rad" in df.columns

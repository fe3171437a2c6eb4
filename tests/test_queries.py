"""Every registered query of the library against its SQL on the small tables."""

import os

import pytest

import __spark_entry__ as entry
from seqloom.plans.registry import REGISTRY
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry_is_complete():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 77 and set(o) <= set(q) and set(REGISTRY) <= set(q)


@pytest.mark.parametrize("key", list(REGISTRY))
def test_matches_sql(spark, con, key):
    ok, info = compare(spark, con, key, entry.queries()[key], entry.oracle_sql().get(key), SF)
    assert ok, info


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["clip_id", "step", "dim", "v"] and not df.isEmpty()

"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from ledgertree.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
QUERIES, CHECKS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    found = compare.differences(spark, con, key, QUERIES[key], CHECKS[key], SF_DIR)
    assert [f for f in found if f != "both empty"] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0

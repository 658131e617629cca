"""Every query with a SQL check, against DuckDB on the same tables."""

from __future__ import annotations

import os

import pytest
from compare import connect, difference

from riskloom.plans import catalog

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.checks()))
def test_query_equals_sql(spark, con, name):
    result = catalog.queries()[name](spark, FOLDER)
    assert difference(result, con, catalog.checks()[name]) is None


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())

"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = os.environ.get("EVIGRAPH_TEST_SF", "/root/testdata/sf0.001")
ORACLES = oracle_sql()
MAY_BE_EMPTY = {"g10_jaccard"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    status, _, _, note = compare(spark, con, SF, name, queries()[name], ORACLES[name])
    assert status == "ok" or (status == "EMPTY" and name in MAY_BE_EMPTY), note


def test_entry(spark):
    assert entry(spark).count() > 0

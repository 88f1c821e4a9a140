"""Every registered query against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from checks.compare import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, con, name):
    text, _, good = compare(spark, con, FOLDER, name, contract.queries()[name], contract.oracle_sql().get(name))
    assert good or text.startswith("ok 0 rows"), text


def test_entry(spark):
    result = contract.entry(spark)
    rows = result.collect()
    assert rows and all(r["unmatched_chunks"] == 0 for r in rows)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())

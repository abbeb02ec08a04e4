"""Every query against its SQL twin, over whole tables."""

import os

import pytest

import __spark_entry__ as contract
import ledgerloom_oracle
import oracle
from ledgerloom import catalog

SF_DIR = os.environ.get("LEDGER_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.QUERIES, ledgerloom_oracle.ORACLE


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, connection, name):
    assert oracle.differences(QUERIES[name](spark, SF_DIR), connection, SQL[name]) == []


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1

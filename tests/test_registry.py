"""Every registered query agrees with its SQL twin."""

import pytest

import __spark_entry__ as contract
from verification.compare import connect, differences
from verification.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, name, SF) is None

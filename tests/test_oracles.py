"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest
from compare import check

from digestmill.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_oracles_are_complete():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, message = check(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, message


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())

"""Every registered query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

from plumbline.plans import suite
from tests import oracle

suite.load()


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    problem, rows, _ = oracle.run(spark, con, name)
    assert problem is None, problem
    assert rows > 0


def test_only_random_queries_have_no_sql():
    assert set(suite.QUERIES) - set(suite.ORACLES) == {
        "null_multinomial", "concentration_report", "scale_robustness",
    }


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.queries().keys() >= contract.oracle_sql().keys()
    report = contract.entry(spark)
    assert {r["subject"] for r in report.collect()} == {"most_concentrated", "highest_raw_count"}

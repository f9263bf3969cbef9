"""Every registered query of the core against DuckDB on the smallest tables; those without SQL give rows twice alike."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry
from hearthline.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SMALL), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_repeats(spark, name):
    rows = [sorted(map(repr, QUERIES[name](spark, SMALL).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 50 and [r["price_deviation"] for r in rows] == sorted(r["price_deviation"] for r in rows)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())

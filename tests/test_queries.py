"""Every query with SQL against DuckDB at the smallest scale; the others must give rows."""

import oracle
import pytest

import __spark_entry__ as contract
from statloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SLOW = {"q_gbt_regressor", "q_kmeans_sweep", "q_three_class", "q_model_comparison"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), SQL[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 4
    assert set(contract.oracle_sql()) <= set(contract.queries())

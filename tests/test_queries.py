"""The driver contract: every registered query runs and equals its SQL twin exactly."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare, duck_connection

import __spark_entry__ as entry_mod
from evidence_spark.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["model", "avg_recall", "avg_precision", "avg_f1", "avg_bm25", "avg_format_score", "count"]


def test_contract_keys():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_every_query_of_the_inventory_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    problems, _ = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert not problems, problems

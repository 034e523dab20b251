"""The correctness gate: every registered query against its DuckDB SQL twin at sf0.01."""

import pytest

import __spark_entry__ as entry
from conftest import SF_ORACLE, SF_SMALL
from oracle_compare import compare, duck_connect

from ledgerlens.plans import registry

# The training-data queries have tests of their own in tests/llm.
KEYS = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return duck_connect(SF_ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["event_type", "calendar_date", "wau_7"]


def test_every_query_has_sql():
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    res = compare(spark, SF_ORACLE, key, entry.queries()[key], entry.oracle_sql().get(key), duck)
    assert res["status"] == "match", res
    assert res["spark_rows"] > 0


@pytest.mark.parametrize("key", ["cashback_payments", "storyline", "cohort_churn", "rolling_active_35"])
def test_small_scale_runs(spark, key):
    assert entry.queries()[key](spark, SF_SMALL).count() >= 0

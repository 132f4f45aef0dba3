"""__spark_entry__: entry() runs; every query agrees with its DuckDB oracle
on sf0.001 (the driver does the same at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_mod  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from roomlens.plans import registry  # noqa: E402

# Reference queries without a twin; the training-data ones are tested in tests/llm.
NO_ORACLE: set[str] = set()


def test_entry_runs(spark, sf_small):
    df = entry_mod.entry(spark)
    assert df.count() >= 0
    assert df.columns == entry_mod.entry(spark).columns


def test_every_query_has_an_oracle_or_is_listed():
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(sqls) <= set(qs)
    assert set(registry.queries()) - set(sqls) == NO_ORACLE


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_oracle(spark, con, sf_small, name):
    msg = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql().get(name), sf_small)
    assert "OK" in msg or "no oracle" in msg, msg

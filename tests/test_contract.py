"""Every registered query against DuckDB on the same tables."""

import pytest
from compare import connect, difference
from conftest import SF_DIR

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_results_hold_plain_columns(spark, sf_dir):
    """Hashing compares scalar values, so no query returns nested ones."""
    for name in ("a7_eval_report", "j1_control_dim", "n7_dense_backward"):
        assert all("<" not in t for _, t in QUERIES[name](spark, sf_dir).dtypes)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert [r["file"] for r in rows] == ["0", "1", "2", "TOTAL"]
    assert rows[-1]["num_entries"] == sum(r["num_entries"] for r in rows[:-1])

"""Every registered query against its DuckDB oracle (or, without one, a
successful run) on the smallest data set."""

import pytest

from conftest import SMOKE
from oracle_harness import compare, duck

import __spark_entry__ as E

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMOKE)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "gate_allowed", "best_distance", "gate_reason"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, SMOKE).count() > 0
        return
    ok, msg = compare(spark, name, QUERIES[name], SQL[name], SMOKE, con)
    assert ok, msg

"""Driver contract: entry smoke check, registered queries vs their oracle SQL."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"dim", "dim_key", "record", "win_rate_pct"} <= set(df.columns)


def test_every_query_has_an_oracle():
    """The corpus queries have their own tests; some are beyond SQL."""
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert own == set(E.oracle_sql()) - set(E.LLM_SQL)


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf_small, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], sf_small, con)
    assert r["ok"], r

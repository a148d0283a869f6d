"""Every registered query against its SQL in DuckDB."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry

QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) in ("", "both are empty")
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "cpk" in df.columns and df.count() > 0

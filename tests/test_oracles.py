"""Every query of the library against its DuckDB oracle on the smallest tables."""

import pytest
from oracle import connect, differences

from streamweave import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_oracle(spark, sf, con, name):
    assert differences(catalog.QUERIES[name](spark, sf), con, catalog.ORACLE_SQL[name], 1e-9) == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf)
    assert rows.count() > 0
    if "same" in rows.columns:
        assert rows.where("not same or same is null").count() == 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

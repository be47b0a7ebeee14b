"""Every registered query of the governed-data operators against DuckDB, or its rows where SQL has no form."""

import pytest
from conftest import SMALL, same_rows

from tessera.plans import registry


#: Queries whose right result on the smallest tables is empty.
EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLES:
        assert same_rows(df, oracle, registry.ORACLES[name]) > 0 or name in EMPTY
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

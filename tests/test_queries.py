"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connection, differences

from lodestream import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: Those with a plan of dozens of joins: one of each kind is enough here, bench and driver run them all.
SLOW = {"rank_features", "reason_codes", "freshness_boost", "familiarity_cap", "candidates_merged", "explore_rerank"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

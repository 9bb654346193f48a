"""Every query with an SQL twin gives the same rows as DuckDB; the others run and give rows."""

import oracle
import pytest

from tidemark.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    query, sql = registry.queries()[name], registry.oracle_sql().get(name)
    if sql:
        assert oracle.differences(spark, con, sf, query, sql) == ""
    else:
        assert query(spark, sf).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

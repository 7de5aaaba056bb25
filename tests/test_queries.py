"""Every query of the core against its SQL, over whole tables."""

import pytest

from lodestrand import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(name, spark, duck, same, data):
    same(catalog.QUERIES[name](spark, data), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

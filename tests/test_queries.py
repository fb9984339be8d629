"""Every registered query of the web side against its SQL."""

import pytest
from tests.conftest import same
from silkpage.plans.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        same(got, oracle.sql(SQL[name]).df())


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

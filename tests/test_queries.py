"""Every registered query with an SQL counterpart, against it; the others run."""

import pytest
from helpers import connect, same

from wordloom.plans import catalog, oracle


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), con.execute(oracle.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(oracle.SQL) <= set(__spark_entry__.queries())

"""Every query that SQL can express equals its SQL, and every other one runs."""

import pytest

from evidora.plans import catalog
from tests.conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SMALL).toPandas()
    theirs = duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours, sorted(ours.columns)) == rows_of(theirs, sorted(ours.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_twice_alike(spark, name):
    a = catalog.QUERIES[name](spark, SMALL).toPandas()
    b = catalog.QUERIES[name](spark, SMALL).toPandas()
    assert len(a) and rows_of(a, sorted(a.columns)) == rows_of(b, sorted(a.columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

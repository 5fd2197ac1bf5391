"""Every registered query of the library against its SQL, and what has none against its parts."""

import pytest

from quern.plans import catalogue

from . import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    oracle.same(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(out)
    if "error" in out:
        assert out["error"].isna().all()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

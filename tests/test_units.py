"""Regressions don't depend on the units of their series, so they hold on larger tables, where counts are larger."""

import numpy as np
import pytest

from quern.functions import series
from quern.plans import catalogue

from . import oracle


def _series():
    rng = np.random.default_rng(5)
    x, s = rng.normal(size=80), 1900 + 30 * rng.normal(size=80)
    return x + rng.normal(size=80), np.stack([np.ones(80), 0.5 + x / 100, rng.normal(size=80), s, s * (0.5 + x / 100)], 1)


@pytest.mark.parametrize("scale", [1e-9, 6.0, 60.0, 1e6, 1e12])
def test_larger_units(scale):
    y, x = _series()
    one, other = series.newey_west_ols(y, x, 4), series.newey_west_ols(y, x * [1, 1, 1, scale, scale], 4)
    assert other.coefficients * [1, 1, 1, scale, scale] == pytest.approx(one.coefficients, rel=1e-7)
    assert other.standard_errors * [1, 1, 1, scale, scale] == pytest.approx(one.standard_errors, rel=1e-7)
    assert other.r_squared == pytest.approx(one.r_squared, abs=1e-9)


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e12])
def test_dependent_in_any_units(scale):
    y, x = _series()
    for more in (scale * (2 * x[:, 1] - x[:, 3]), np.zeros(80), np.full(80, scale)):
        with pytest.raises(ValueError, match="dependent"):
            series.newey_west_ols(y, np.column_stack([x, more]), 4)
        with pytest.raises(ValueError, match="dependent"):
            series.driscoll_kraay_ols(y, np.column_stack([x, more]), np.zeros(80), np.arange(80), 4)


@pytest.mark.parametrize("times", [6, 60])
def test_projections_of_more_orders(spark, tmp_path, times):
    folder = str(tmp_path)
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.1/{t}.parquet")
    (tmp_path / "orders.parquet").unlink()
    oracle.connect("/root/testdata/sf0.1").sql(f"copy (select o.* replace (o_orderkey + r * 1000000 as o_orderkey) from orders o, range({times}) t(r)) to '{folder}/orders.parquet' (format parquet)")
    got = oracle.same(catalogue.QUERIES["projection_points"](spark, folder), catalogue.ORACLES["projection_points"], folder)
    assert [r["n_obs"] for r in sorted(got, key=lambda r: r["h"])] == [78, 77, 76, 75, 74, 73, 72, 71]
    whole = catalogue.QUERIES["local_projection"](spark, folder).toPandas()
    assert whole["error"].isna().all() and whole["interaction"].notna().all()

"""Numeric kernels: closed forms, identities, simulation."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import coders, series


def walk(seed, n=100, rho=0.7):
    rng = np.random.default_rng(seed)
    out = np.zeros(n)
    for i in range(1, n):
        out[i] = rho * out[i - 1] + rng.normal()
    return out


def test_incomplete_beta_closed_forms():
    for x in (0.05, 0.3, 0.5, 0.77, 0.99):
        assert series.regularised_incomplete_beta(1, 1, x) == pytest.approx(x, abs=1e-12)
        assert series.regularised_incomplete_beta(0.5, 0.5, x) == pytest.approx(2 / math.pi * math.asin(math.sqrt(x)), abs=1e-12)
        assert series.regularised_incomplete_beta(2, 3, x) == pytest.approx(6 * x**2 - 8 * x**3 + 3 * x**4, abs=1e-12)
    assert series.two_sided_t_pvalue(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert series.two_sided_t_pvalue(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6)
    with pytest.raises(ValueError):
        series.regularised_incomplete_beta(0, 1, 0.5)


def test_hac_by_definition():
    x, y = walk(1), walk(2)
    design = np.column_stack([np.ones(100), x])
    for lags in (0, 1, 4, 9):
        inv = np.linalg.inv(design.T @ design)
        e = y - design @ (inv @ design.T @ y)
        s = design * e[:, None]
        total = np.zeros((2, 2))
        for i in range(100):
            for j in range(max(0, i - lags), min(100, i + lags + 1)):
                total += (1 - abs(i - j) / (lags + 1)) * np.outer(s[i], s[j])
        want = np.sqrt(np.diag(inv @ total @ inv) * 100 / 98)
        assert series.newey_west_ols(y, design, lags).standard_errors == pytest.approx(want, rel=1e-10)
        assert series.driscoll_kraay_ols(y, design, np.zeros(100), np.arange(100), lags).standard_errors == pytest.approx(want, rel=1e-10)


def test_guards():
    one = np.ones((20, 1))
    for y, x, lags in ((np.ones(5), np.ones((4, 1)), 0), (np.full(20, np.nan), one, 0), (np.ones(1), one[:1], 0), (walk(1, 20), one, 20), (walk(1, 20), np.ones((20, 2)), 1)):
        with pytest.raises(ValueError):
            series.newey_west_ols(y, x, lags)
    with pytest.raises(ValueError):
        series.standardise(np.ones(5))
    with pytest.raises(ValueError):
        series.newey_west_bandwidth(0)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(15, 80))
def test_correlation_identities(seed, n):
    x, y = walk(seed, n), walk(seed + 1, n)
    c, back = series.correlation_hac(x, y), series.correlation_hac(y, x)
    assert c.correlation == pytest.approx(back.correlation, abs=1e-12) and -1 <= c.correlation <= 1
    assert c.ci_low <= c.correlation <= c.ci_high and 0 <= c.p_value <= 1
    moved = series.correlation_hac(3 * x + 1, -2 * y)
    assert moved.correlation == pytest.approx(-c.correlation, abs=1e-9) and moved.standard_error == pytest.approx(c.standard_error, rel=1e-6)
    assert series.effective_sample_size(x, y) <= n


def test_era_difference_is_difference_of_correlations():
    x, y, late = walk(3), walk(4), np.arange(100) >= 40
    d, se, p = series.era_difference(x, y, late)
    assert d == pytest.approx(np.corrcoef(x[late], y[late])[0, 1] - np.corrcoef(x[~late], y[~late])[0, 1]) and se > 0 and 0 <= p <= 1


def test_partial_correlation_closed_form():
    x, y, z = walk(5), walk(6), walk(7)
    r = np.corrcoef([x, y, z])
    want = (r[0, 1] - r[0, 2] * r[1, 2]) / math.sqrt((1 - r[0, 2] ** 2) * (1 - r[1, 2] ** 2))
    assert series.partial_correlation(x, y, z).correlation == pytest.approx(want, abs=1e-10)


def test_prais_winsten_without_persistence_is_ols():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=4000), rng.normal(size=4000)
    r = np.corrcoef(x, y)[0, 1]
    got = series.prais_winsten_correlation(x, y)
    assert got.correlation == pytest.approx(r) and got.t_statistic == pytest.approx(r * math.sqrt(3998 / (1 - r * r)), abs=0.05)


def test_bandwidths():
    for lags in range(1, 7):
        low, high = series.bandwidth_band(lags)
        assert [series.newey_west_bandwidth(n) for n in (low, high, high + 1)] == [lags, lags, lags + 1]
    assert [series.bootstrap_block_length(n) for n in (1, 8, 9, 100)] == [1, 2, 3, 5]


def test_block_bootstrap_covers():
    x = walk(8)
    low, high = series.moving_block_bootstrap_ci(x, x + 2 * walk(9), 5, 1000)
    assert low < np.corrcoef(x, x + 2 * walk(9))[0, 1] < high
    assert (low, high) == series.moving_block_bootstrap_ci(x, x + 2 * walk(9), 5, 1000)
    with pytest.raises(ValueError):
        series.moving_block_bootstrap_ci(x, x, 101)


def test_williams_is_antisymmetric():
    t, p = series.williams_t(0.5, 0.3, 0.4, 100)
    assert series.williams_t(0.3, 0.5, 0.4, 100) == (pytest.approx(-t), pytest.approx(p))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
def test_holm(p):
    out = series.holm_adjust(p)
    assert all(a >= b - 1e-15 and a <= 1 for a, b in zip(out, p))
    order = np.argsort(p, kind="stable")
    assert all(out[a] <= out[b] + 1e-15 for a, b in zip(order, order[1:]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-1, 0, 1]), st.sampled_from([-1, 0, 1])), min_size=2, max_size=40))
def test_kappa(rows):
    a, b = zip(*rows)
    observed, k = coders.cohen_kappa(a, b, [-1, 0, 1])
    assert (observed, k) == pytest.approx(coders.cohen_kappa(b, a, [-1, 0, 1]), nan_ok=True)
    assert math.isnan(k) or k <= 1 + 1e-12


def test_clopper_pearson():
    assert coders.clopper_pearson_ci(0, 10) == (0.0, pytest.approx(1 - 0.025**0.1, abs=1e-12))
    assert coders.clopper_pearson_ci(10, 10) == (pytest.approx(0.025**0.1, abs=1e-12), 1.0)
    assert all(math.isnan(x) for x in coders.clopper_pearson_ci(0, 0))
    for k, n in ((3, 20), (400, 900), (14000, 15000)):
        low, high = coders.clopper_pearson_ci(k, n)
        assert low < k / n < high
        assert coders.binomial_cdf(k, n, high) == pytest.approx(0.025, abs=1e-9) and 1 - coders.binomial_cdf(k - 1, n, low) == pytest.approx(0.025, abs=1e-9)


def test_error_rates():
    r = coders.sensitivity_specificity([1, 1, 1, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0, 1])
    assert (r["tp"], r["fn"], r["tn"], r["fp"]) == (2, 1, 3, 1) and r["sensitivity"] == pytest.approx(2 / 3)
    e = coders.estimate_error_rates([1, 0], [0, 0])
    assert math.isnan(e.sensitivity) and e.specificity == 0.5
    assert coders.correct_share(0.5, 0.9, 0.8) == pytest.approx(3 / 7) and coders.correct_share(0.5, 0.4, 0.6) == 0.5
    assert coders.corrected_share_bounds(0.5, (0.9, 1.0), (0.8, 0.9)) == (pytest.approx(0.4 / 0.9 if 0 else min(0.3 / 0.7, 0.4 / 0.8, 0.3 / 0.8, 0.4 / 0.9)), pytest.approx(max(0.3 / 0.7, 0.4 / 0.8, 0.3 / 0.8, 0.4 / 0.9)))
    sens, spec, prev = coders.recover_rates(0.8, 0.9, 0.4)
    assert prev == pytest.approx(0.38) and sens == pytest.approx(0.32 / 0.38) and spec == pytest.approx(0.54 / 0.62)
    assert coders.sign_test(5, 5) == 0.03125

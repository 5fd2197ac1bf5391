"""Small-sample statistics of time series, on plain numpy arrays (no Spark here).

Spark sends each group of a long frame to one of these, see
``quern.operators.inference``. Missing values are dropped before; what reaches
a kernel is finite.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

#: The seed and number of draws of all bootstrap intervals, and the normal quantile of 95% intervals.
SEED, DRAWS, NORMAL_95 = 20250824, 10_000, 1.959964
#: Pairs that a correlation needs.
LEAST_PAIRS = 12


def regularised_incomplete_beta(a: float, b: float, x: float, terms: int = 400) -> float:
    """I_x(a, b), by the even-odd continued fraction taken from its far end."""
    if not 0 <= x <= 1 or a <= 0 or b <= 0:
        raise ValueError("need a, b > 0 and 0 <= x <= 1")
    if x in (0.0, 1.0):
        return float(x)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularised_incomplete_beta(b, a, 1.0 - x, terms)
    value = 1.0
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    first = -(a + b) * x / (a + 1)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / a / (1.0 + first / value)


def two_sided_t_pvalue(t: float, df: float) -> float:
    if df <= 0:
        raise ValueError("degrees of freedom must be positive")
    return math.nan if not math.isfinite(t) else regularised_incomplete_beta(df / 2, 0.5, df / (df + t * t))


class Regression(NamedTuple):
    coefficients: np.ndarray
    standard_errors: np.ndarray
    n_obs: int
    n_params: int
    lags: int
    r_squared: float

    @property
    def t_statistics(self) -> np.ndarray:
        return self.coefficients / self.standard_errors

    @property
    def p_values(self) -> np.ndarray:
        return np.array([two_sided_t_pvalue(float(t), self.n_obs - self.n_params) for t in self.t_statistics])

    def confidence_interval(self, index: int) -> tuple[float, float]:
        """95%, with the normal quantile."""
        at, half = float(self.coefficients[index]), NORMAL_95 * float(self.standard_errors[index])
        return at - half, at + half


class Correlation(NamedTuple):
    correlation: float
    standard_error: float
    t_statistic: float
    p_value: float
    ci_low: float
    ci_high: float
    n_obs: int
    lags: int


class AdjustedCorrelation(NamedTuple):
    correlation: float
    n_obs: int
    n_effective: float
    t_statistic: float
    p_value: float


def newey_west_bandwidth(n: int, min_lags: int = 0) -> int:
    if n <= 0:
        raise ValueError("no observations")
    return max(math.floor(4 * (n / 100) ** (2 / 9)), min_lags)


def bandwidth_band(lags: int) -> tuple[int, int]:
    """The least and the greatest n whose automatic bandwidth is ``lags``."""
    low, high = (math.ceil(100 * (k / 4) ** 4.5 - 1e-9) for k in (lags, lags + 1))
    while low > 1 and newey_west_bandwidth(low - 1) >= lags:
        low -= 1
    while newey_west_bandwidth(max(low, 1)) < lags:
        low += 1
    while newey_west_bandwidth(high) <= lags:
        high += 1
    while newey_west_bandwidth(high - 1) > lags:
        high -= 1
    return max(low, 1), high - 1


def bootstrap_block_length(n: int, min_block: int = 1) -> int:
    if n <= 0:
        raise ValueError("no observations")
    return max(math.ceil(n ** (1 / 3)), min_block)


def _bartlett(scores: np.ndarray, lags: int) -> np.ndarray:
    """Long-run covariance of the rows of ``scores``: a weighted sum over all pairs of rows at most ``lags`` apart."""
    kernel = 1 - np.abs(np.arange(-lags, lags + 1)) / (lags + 1)
    smooth = np.stack([np.convolve(column, kernel)[lags : lags + len(column)] for column in scores.T], 1)
    return scores.T @ smooth


def _sandwich(y: np.ndarray, x: np.ndarray, lags: int, dates: np.ndarray | None = None) -> Regression:
    n, k = x.shape
    size = np.linalg.norm(x, axis=0)
    unit = x / np.where(size > 0, size, 1.0)  # the units that regressors are measured in decide nothing
    if np.linalg.matrix_rank(unit) < k:
        raise ValueError("regressors are linearly dependent")
    q, r = np.linalg.qr(unit)  # x.T @ x would square the condition
    back = np.linalg.inv(r) / size[:, None]
    beta = back @ (q.T @ y)
    errors = y - x @ beta
    scores = q * errors[:, None]
    if dates is not None:
        _, at = np.unique(dates, return_inverse=True)
        summed = np.zeros((at.max() + 1, k))
        np.add.at(summed, at, scores)
        scores = summed
    variance = np.diag(back @ _bartlett(scores, lags) @ back.T) * n / (n - k)
    if not (variance > 0).all():
        raise ValueError("the kernel estimate of a variance is not positive")
    spread = float(((y - y.mean()) ** 2).sum())
    return Regression(beta, np.sqrt(variance), n, k, lags, 1 - float(errors @ errors) / spread if spread > 0 else math.nan)


def newey_west_ols(y: np.ndarray, x: np.ndarray, lags: int) -> Regression:
    """Least squares with Bartlett-kernel standard errors, scaled by n / (n - k). ``x`` holds its own intercept."""
    y, x = np.asarray(y, float), np.asarray(x, float)
    if y.ndim != 1 or x.ndim != 2 or len(x) != len(y):
        raise ValueError("y must be (n,) and x (n, k)")
    if not (np.isfinite(y).all() and np.isfinite(x).all()):
        raise ValueError("values must be finite")
    if len(y) <= x.shape[1]:
        raise ValueError("more parameters than observations")
    if not 0 <= lags < len(y):
        raise ValueError("bandwidth out of range")
    return _sandwich(y, x, lags)


def driscoll_kraay_ols(y: np.ndarray, x: np.ndarray, unit: np.ndarray, time: np.ndarray, lags: int) -> Regression:
    """As ``newey_west_ols`` for a panel: scores are summed over the units of each date first."""
    return _sandwich(np.asarray(y, float), np.asarray(x, float), lags, np.asarray(time))


def standardise(values: np.ndarray) -> np.ndarray:
    values = np.asarray(values, float)
    spread = values.std(ddof=1) if len(values) > 1 else 0.0
    if not np.isfinite(spread) or spread <= 0:
        raise ValueError("a constant series can't be standardised")
    return (values - values.mean()) / spread


def correlation_hac(x: np.ndarray, y: np.ndarray, min_lags: int = 0) -> Correlation:
    """Pearson correlation; its standard error is that of the slope between standardised series."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if x.shape != y.shape:
        raise ValueError("series differ in length")
    lags = newey_west_bandwidth(len(x), min_lags)
    fit = newey_west_ols(standardise(y), np.stack([np.ones(len(x)), standardise(x)], 1), lags)
    r = float(np.corrcoef(x, y)[0, 1])
    if abs(r - fit.coefficients[1]) > 1e-8:
        raise ValueError("slope and correlation differ")
    return Correlation(r, float(fit.standard_errors[1]), float(fit.t_statistics[1]), float(fit.p_values[1]), *fit.confidence_interval(1), len(x), lags)


def moving_block_bootstrap_ci(x: np.ndarray, y: np.ndarray, block_length: int, n_draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of a correlation, from resampled blocks of pairs; the draws come one after another from one generator."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if not 1 <= block_length <= n:
        raise ValueError("block length out of range")
    rng, count = np.random.default_rng(seed), -(-n // block_length)
    starts = np.stack([rng.integers(0, n - block_length + 1, count) for _ in range(n_draws)])
    picks = (starts[:, :, None] + np.arange(block_length)).reshape(n_draws, -1)[:, :n]
    a, b = x[picks], y[picks]
    usable = (a.std(1) > 0) & (b.std(1) > 0)
    if usable.sum() < n_draws / 2:
        raise ValueError("too few draws vary")
    a, b = (v[usable] - v[usable].mean(1, keepdims=True) for v in (a, b))
    r = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return tuple(np.percentile(np.clip(r, -1, 1), [2.5, 97.5]).tolist())


def autocorrelations(x: np.ndarray, max_lag: int) -> np.ndarray:
    d = np.asarray(x, float) - np.mean(x)
    return np.array([d[k:] @ d[: len(d) - k] for k in range(1, max_lag + 1)]) / (d @ d)


def effective_sample_size(x: np.ndarray, y: np.ndarray, max_lag: int | None = None) -> float:
    """1 / n_eff = 1 / n + 2 / n times the sum of products of autocorrelations, to lag n // 5; at most n."""
    n = len(x)
    upto = max(1, n // 5) if max_lag is None else max_lag
    inverse = (1 + 2 * float(autocorrelations(x, upto) @ autocorrelations(y, upto))) / n
    return float(n) if inverse <= 0 else min(float(n), 1 / inverse)


def correlation_effective_n(x: np.ndarray, y: np.ndarray) -> AdjustedCorrelation:
    r, n_eff = float(np.corrcoef(x, y)[0, 1]), effective_sample_size(x, y)
    if n_eff <= 2 or abs(r) >= 1:
        return AdjustedCorrelation(r, len(x), n_eff, math.nan, math.nan)
    t = r * math.sqrt((n_eff - 2) / (1 - r * r))
    return AdjustedCorrelation(r, len(x), n_eff, t, two_sided_t_pvalue(t, n_eff - 2))


def prais_winsten_correlation(x: np.ndarray, y: np.ndarray) -> AdjustedCorrelation:
    """The raw correlation, tested after an AR(1) is taken out of the errors (rho within 0.99)."""
    n, xs, ys = len(x), standardise(x), standardise(y)
    design = np.stack([np.ones(n), xs, ys], 1)
    errors = ys - design[:, :2] @ np.linalg.lstsq(design[:, :2], ys, rcond=None)[0]
    rho = min(0.99, max(-0.99, float(errors[1:] @ errors[:-1]) / float(errors[:-1] @ errors[:-1])))
    moved = design.copy()
    moved[1:] -= rho * design[:-1]
    moved[0] *= math.sqrt(1 - rho * rho)
    z, target = moved[:, :2], moved[:, 2]
    b = np.linalg.lstsq(z, target, rcond=None)[0]
    left = target - z @ b
    t = float(b[1]) / math.sqrt(float(left @ left) / (n - 2) * float(np.linalg.inv(z.T @ z)[1, 1]))
    return AdjustedCorrelation(float(np.corrcoef(x, y)[0, 1]), n, float(n), t, two_sided_t_pvalue(t, n - 2))


def residuals(y: np.ndarray, *controls: np.ndarray) -> np.ndarray:
    """What an intercept and the controls leave of ``y``."""
    design = np.stack([np.ones(len(y)), *[np.asarray(c, float) for c in controls]], 1)
    return np.asarray(y, float) - design @ np.linalg.lstsq(design, np.asarray(y, float), rcond=None)[0]


def partial_correlation(x: np.ndarray, y: np.ndarray, control: np.ndarray, both: bool = True, min_lags: int = 0) -> Correlation:
    """Correlation with the control taken out of x (semi-partial), or of both."""
    return correlation_hac(residuals(x, control), residuals(y, control) if both else y, min_lags)


def williams_t(r_xy: float, r_xz: float, r_yz: float, n: int) -> tuple[float, float]:
    """t and two-sided p of the difference of two correlations with one variable in common (x with y, x with z)."""
    det = 1 - r_xy**2 - r_xz**2 - r_yz**2 + 2 * r_xy * r_xz * r_yz
    mean = (r_xy + r_xz) / 2
    below = 2 * det * (n - 1) / (n - 3) + mean**2 * (1 - r_yz) ** 3
    t = (r_xy - r_xz) * math.sqrt((n - 1) * (1 + r_yz) / below)
    return t, two_sided_t_pvalue(t, n - 3)


def correlation_difference_hac(x: np.ndarray, y: np.ndarray, z: np.ndarray, min_lags: int = 0) -> tuple[float, float, float]:
    """Difference r(x, y) - r(x, z), its HAC standard error and p: the slope of (y - z), standardised, on x."""
    n = len(x)
    lags = newey_west_bandwidth(n, min_lags)
    fit = newey_west_ols(standardise(y) - standardise(z), np.stack([np.ones(n), standardise(x)], 1), lags)
    return float(fit.coefficients[1]), float(fit.standard_errors[1]), float(fit.p_values[1])


def era_difference(x: np.ndarray, y: np.ndarray, late: np.ndarray, min_lags: int = 0) -> tuple[float, float, float]:
    """Late minus early correlation, standard error and p: the interaction in a regression standardised within eras."""
    late = np.asarray(late, bool)
    xs, ys = np.empty(len(x)), np.empty(len(x))
    for era in (late, ~late):
        xs[era], ys[era] = standardise(np.asarray(x, float)[era]), standardise(np.asarray(y, float)[era])
    one, d = np.ones(len(x)), late.astype(float)
    fit = newey_west_ols(ys, np.stack([one, xs, d, d * xs], 1), newey_west_bandwidth(len(x), min_lags))
    gap = np.corrcoef(np.asarray(x)[late], np.asarray(y)[late])[0, 1] - np.corrcoef(np.asarray(x)[~late], np.asarray(y)[~late])[0, 1]
    if abs(gap - fit.coefficients[3]) > 1e-8:
        raise ValueError("interaction and difference of correlations differ")
    return float(fit.coefficients[3]), float(fit.standard_errors[3]), float(fit.p_values[3])


def holm_adjust(p: list[float]) -> list[float]:
    """Step-down adjusted p values, in the given order."""
    order, out, top = np.argsort(p, kind="stable"), np.empty(len(p)), 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, (len(p) - rank) * p[i]))
        out[i] = top
    return out.tolist()

"""Agreement and error rates of coders, on plain arrays (no Spark here)."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from .series import DRAWS, SEED, regularised_incomplete_beta

#: The six coded variables and their categories.
ATTENTION = ["inflation_attention", "growth_attention", "financial_stability_attention", "uncertainty_attention"]
OUTLOOK = {"inflation_outlook": "inflation_attention", "growth_outlook": "growth_attention"}
VARIABLES = [*ATTENTION, *OUTLOOK]


def categories_for(variable: str) -> list[int]:
    return [-1, 0, 1] if variable.endswith("_outlook") else [0, 1]


def cohen_kappa(a, b, categories: list[int]) -> tuple[float, float]:
    """Observed agreement and kappa; kappa is NaN where chance alone agrees always."""
    a, b = np.asarray(a), np.asarray(b)
    observed = float((a == b).mean())
    chance = float(sum((a == c).mean() * (b == c).mean() for c in categories))
    return observed, math.nan if chance >= 1 else (observed - chance) / (1 - chance)


def bootstrap_kappa_ci(a, b, categories: list[int], n_draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of kappa over resampled items; undefined draws are left out. All draws come from one generator."""
    a, b = np.asarray(a), np.asarray(b)
    n, rng = len(a), np.random.default_rng(seed)
    picks = np.stack([rng.integers(0, n, n) for _ in range(n_draws)])
    da, db = a[picks], b[picks]
    observed = (da == db).mean(1)
    chance = sum((da == c).mean(1) * (db == c).mean(1) for c in categories)
    fine = chance < 1
    if not fine.any():
        return math.nan, math.nan
    kappa = (observed[fine] - chance[fine]) / (1 - chance[fine])
    return tuple(np.percentile(kappa, [2.5, 97.5]).tolist())


def bootstrap_kappa_cells_ci(a, b, count, categories: list[int], n_draws: int = DRAWS, seed: int = SEED) -> tuple[float, float]:
    """The same interval from the number of items in each cell (a, b), in the order of cells: items resampled with replacement make multinomial counts."""
    a, b, count = np.asarray(a), np.asarray(b), np.asarray(count, np.int64)
    n = int(count.sum())
    share = np.random.default_rng(seed).multinomial(n, count / n, n_draws) / n
    observed = share[:, a == b].sum(1)
    chance = sum(share[:, a == c].sum(1) * share[:, b == c].sum(1) for c in categories)
    fine = chance < 1 - 1e-12
    if not fine.any():
        return math.nan, math.nan
    kappa = (observed[fine] - chance[fine]) / (1 - chance[fine])
    return tuple(np.percentile(kappa, [2.5, 97.5]).tolist())


def binomial_cdf(k: int, n: int, p: float) -> float:
    if n > 500 and 0 <= k < n:  # the sum's terms would leave the floats
        return regularised_incomplete_beta(n - k, k + 1, 1 - p)
    return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if k >= 0 else 0.0


def _crossing(falls, target: float) -> float:
    """Where a function that falls from p = 0 to p = 1 meets the target."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if falls(mid) > target else (low, mid)
    return (low + high) / 2


def clopper_pearson_ci(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval of a share; NaN without trials."""
    if n == 0:
        return math.nan, math.nan
    low = 0.0 if k == 0 else _crossing(lambda p: binomial_cdf(k - 1, n, p), 1 - alpha / 2)
    high = 1.0 if k == n else _crossing(lambda p: binomial_cdf(k, n, p), alpha / 2)
    return low, high


def sign_test(positive: int, n: int) -> float:
    """One-sided exact p of ``positive`` or more of n signs."""
    return sum(math.comb(n, i) for i in range(positive, n + 1)) / 2**n


class ErrorRates(NamedTuple):
    sensitivity: float
    specificity: float
    n_true_one: int
    n_true_zero: int


def _share(hits: int, n: int) -> float:
    return hits / n if n else math.nan


def estimate_error_rates(model, human) -> ErrorRates:
    model, human = np.asarray(model), np.asarray(human)
    ones, zeros = int((human == 1).sum()), int((human == 0).sum())
    return ErrorRates(_share(int(((human == 1) & (model == 1)).sum()), ones), _share(int(((human == 0) & (model == 0)).sum()), zeros), ones, zeros)


def sensitivity_specificity(reference, candidate) -> dict[str, float]:
    """Counts, both rates and their exact intervals."""
    r, c = np.asarray(reference), np.asarray(candidate)
    tp, fn, tn, fp = (int(((r == x) & (c == y)).sum()) for x, y in ((1, 1), (1, 0), (0, 0), (0, 1)))
    sens, spec = clopper_pearson_ci(tp, tp + fn), clopper_pearson_ci(tn, tn + fp)
    return {
        "tp": tp, "fn": fn, "tn": tn, "fp": fp, "n_true_one": tp + fn, "n_true_zero": tn + fp,
        "sensitivity": _share(tp, tp + fn), "sensitivity_low": sens[0], "sensitivity_high": sens[1],
        "specificity": _share(tn, tn + fp), "specificity_low": spec[0], "specificity_high": spec[1],
    }


#: A pair of rates tells something only if they exceed one together by more than this.
INFORMATIVE = 1e-6


def correct_share(share, sensitivity: float, specificity: float):
    """The true share behind an observed one, within [0, 1]; as it is where the rates tell nothing."""
    gain = sensitivity + specificity - 1
    if not gain > INFORMATIVE:
        return share
    return np.clip((np.asarray(share, float) - (1 - specificity)) / gain, 0, 1)[()]


def corrected_share_bounds(share: float, sens_ci: tuple[float, float], spec_ci: tuple[float, float]) -> tuple[float, float]:
    """Least and greatest corrected share at the corners of both intervals; NaN if no corner tells anything."""
    got = [float(correct_share(share, s, p)) for s in sens_ci for p in spec_ci if math.isfinite(s) and math.isfinite(p) and s + p - 1 > INFORMATIVE]
    return (min(got), max(got)) if got else (math.nan, math.nan)


def recover_rates(ppv: float, npv: float, q: float) -> tuple[float, float, float]:
    """Sensitivity, specificity and prevalence from predictive values and the share q that the model codes 1."""
    p = q * ppv + (1 - q) * (1 - npv)
    return (math.nan, math.nan, p) if not 0 < p < 1 else (q * ppv / p, (1 - q) * npv / (1 - p), p)

"""Small-sample inference for many pairs of series at once.

A long frame (spec, t, x, y) goes group by group to the numpy kernels: one group
is one aligned pair of at most some hundred periods. Rows are sorted inside the
group, so a result doesn't depend on how Spark dealt them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coders, series

CORRELATION = "correlation double, standard_error double, t_statistic double, p_value double, ci_low double, ci_high double, n_obs int, lags int"


def pairs(df: DataFrame, x: str, y: str, t: str, by: dict[str, Column] | None = None, **more: str) -> DataFrame:
    """Long rows t, x, y (and others by name), without missing or infinite values."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    own = {"x": x, "y": y, **more}
    out = df.select(*[c.alias(k) for k, c in (by or {}).items()], F.col(t).alias("t"), *[F.col(c).cast("double").alias(k) for k, c in own.items()])
    for k in own:
        out = out.where(finite(F.col(k)))
    return out


def stack(df: DataFrame, t: str, specs: list[tuple[str, str]]) -> DataFrame:
    """spec, t, x, y for pairs of columns of a wide frame, in one explode."""
    rows = F.array(*[F.struct(F.lit(f"{x}~{y}").alias("spec"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in specs])
    return df.select(F.col(t).alias("t"), F.explode(rows).alias("r")).select("r.spec", "t", "r.x", "r.y").where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def per_group(df: DataFrame, by: list[str], kernel: Callable, schema: str, least: int = series.LEAST_PAIRS, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """One row a group from ``kernel(*columns as arrays)``; groups below ``least`` rows, or that the kernel refuses, have nulls and say why."""
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    names = [part.split()[0] for part in schema.split(",")]

    def run(pdf):
        pdf = pdf.sort_values("t", kind="stable")
        head, error, values = list(pdf[by].iloc[0]), None, None
        if len(pdf) < least:
            error = f"{len(pdf)} observations, {least} needed"
        else:
            try:
                values = kernel(*[pdf[c].to_numpy() for c in columns])
            except (ValueError, np.linalg.LinAlgError) as e:
                error = str(e)
        values = [None] * len(names) if values is None else [None if isinstance(v, float) and math.isnan(v) else v for v in values]
        return pd.DataFrame([[*head, *values, error]], columns=[*by, *names, "error"])

    return df.groupBy(*by).applyInPandas(run, f"{keys}, {schema}, error string")


def correlations(df: DataFrame, by: list[str], min_lags: int = 0) -> DataFrame:
    return per_group(df, by, lambda x, y: series.correlation_hac(x, y, min_lags), CORRELATION)


def correlation_rows(df: DataFrame, by: list[str], expected: dict[str, int] | None = None, min_lags: int = 0, n_draws: int = series.DRAWS) -> DataFrame:
    """Correlation, HAC test and block-bootstrap interval; with the expected sign (by the first key) whether it came out so."""

    def kernel(x, y):
        c = series.correlation_hac(x, y, min_lags)
        return (*c, *series.moving_block_bootstrap_ci(x, y, series.bootstrap_block_length(len(x), min_lags + 1), n_draws))

    out = per_group(df, by, kernel, CORRELATION + ", boot_low double, boot_high double")
    if expected:
        sign = F.create_map(*[F.lit(v) for kv in expected.items() for v in kv])[F.col(by[0])]
        out = out.withColumn("expected_sign", sign).withColumn("as_expected", F.signum("correlation") == F.col("expected_sign"))
    return out.withColumn("stars", stars(F.col("p_value")))


def with_reliability(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation rows with the reliability that an earlier table gives their measure; null where it has none."""
    from . import quality

    return rows.join(quality.require_unique(stored, keys).select(*keys, "reliability"), keys, "left")


def alternative_specs(df: DataFrame, t: str, measure: str, baseline: str, alternatives: list[str], min_lags: int = 0) -> DataFrame:
    """The measure against a baseline series and others in its place: each correlation next to the baseline's, with their difference and whether the sign holds."""
    each = correlations(stack(df, t, [(measure, y) for y in [baseline, *alternatives]]), ["spec"], min_lags)
    own = each.where(F.col("spec") == f"{measure}~{baseline}").select(F.col("correlation").alias("baseline"))
    return each.crossJoin(F.broadcast(own)).withColumns({"difference": F.col("correlation") - F.col("baseline"), "same_sign": F.signum("correlation") == F.signum("baseline")})


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")


def block_intervals(df: DataFrame, by: list[str], n_draws: int = series.DRAWS) -> DataFrame:
    return per_group(df, by, lambda x, y: series.moving_block_bootstrap_ci(x, y, series.bootstrap_block_length(len(x)), n_draws), "low double, high double")


def effective_n(df: DataFrame, by: list[str]) -> DataFrame:
    return per_group(df, by, series.correlation_effective_n, "correlation double, n_obs int, n_effective double, t_statistic double, p_value double")


def prais_winsten(df: DataFrame, by: list[str]) -> DataFrame:
    return per_group(df, by, series.prais_winsten_correlation, "correlation double, n_obs int, n_effective double, t_statistic double, p_value double")


def alternative_inference(df: DataFrame, by: list[str]) -> DataFrame:
    """The three tests next to each other."""
    hac = correlations(df, by).select(*by, "correlation", "n_obs", F.col("p_value").alias("p_hac"))
    eff = effective_n(df, by).select(*by, "n_effective", F.col("p_value").alias("p_effective_n"))
    pw = prais_winsten(df, by).select(*by, F.col("p_value").alias("p_prais_winsten"))
    return hac.join(eff, by).join(pw, by)


def era_differences(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with a boolean column late."""
    return per_group(df, by, lambda x, y, late: series.era_difference(x, y, late), "difference double, standard_error double, p_value double", columns=("x", "y", "late"))


def break_sensitivity(df: DataFrame, year: Column, breaks: list[int]) -> DataFrame:
    """Era differences for several break years: break_year, difference, standard_error, p_value."""
    spark = df.sparkSession
    years = F.broadcast(spark.createDataFrame([(b,) for b in breaks], "break_year int"))
    return era_differences(df.withColumn("_y", year).crossJoin(years).withColumn("late", F.col("_y") >= F.col("break_year")).drop("_y"), ["break_year"])


def partial(df: DataFrame, by: list[str], both: bool = True) -> DataFrame:
    """``df`` with a control column z."""
    return per_group(df, by, lambda x, y, z: series.partial_correlation(x, y, z, both), CORRELATION, columns=("x", "y", "z"))


def dependent_difference(df: DataFrame, by: list[str]) -> DataFrame:
    """r(x, y) against r(x, z): Williams' t and p, and the HAC test of the difference."""

    def kernel(x, y, z):
        r = np.corrcoef([x, y, z])
        t, p = series.williams_t(float(r[0, 1]), float(r[0, 2]), float(r[1, 2]), len(x))
        d, se, ph = series.correlation_difference_hac(x, y, z)
        return float(r[0, 1]), float(r[0, 2]), d, t, p, se, ph

    return per_group(df, by, kernel, "r_xy double, r_xz double, difference double, williams_t double, williams_p double, hac_se double, hac_p double", columns=("x", "y", "z"))


def panel_regression(df: DataFrame, by: list[str], lags: int) -> DataFrame:
    """Driscoll-Kraay slope of y on x; rows have unit and t."""

    def kernel(x, y, unit, t):
        fit = series.driscoll_kraay_ols(y, np.stack([np.ones(len(x)), x], 1), unit, t, lags)
        return float(fit.coefficients[1]), float(fit.standard_errors[1]), float(fit.p_values[1]), fit.n_obs

    return per_group(df, by, kernel, "slope double, standard_error double, p_value double, n_obs int", columns=("x", "y", "unit", "t"))


def local_projections(df: DataFrame, t: str, shock: str, outcome: str, horizons: int = 8, controls: bool = True, interact: str | None = None) -> DataFrame:
    """Change of the outcome over the next h periods on the shock, h = 1..horizons: slope, HAC error (bandwidth at least h - 1), p, interval.

    Controls are the outcome's last change and the lagged shock; ``interact``
    adds a state and its product with the shock, whose coefficient is returned
    as ``interaction``.
    """
    w = Window.orderBy(t)
    rows = df.select(F.col(t).alias("t"), F.col(shock).cast("double").alias("x"), F.col(outcome).cast("double").alias("_o"), *([F.col(interact).cast("double").alias("s")] if interact else []))
    rows = rows.withColumns({"c1": F.col("_o") - F.lag("_o").over(w), "c2": F.lag("x").over(w), **{f"_h{h}": F.lead("_o", h).over(w) - F.col("_o") for h in range(1, horizons + 1)}})
    long = rows.select("*", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_h{h}").alias("y")) for h in range(1, horizons + 1)])).alias("r")).select("t", "x", "c1", "c2", *(["s"] if interact else []), "r.h", "r.y")
    used = ("x", "y", *(("c1", "c2") if controls else ()), *(("s",) if interact else ()))
    for c in used:
        long = long.where(F.col(c).isNotNull())
    long = long.withColumn("h_", F.col("h").cast("double"))

    def kernel(x, y, h, *others):
        lags = max(series.newey_west_bandwidth(len(x)), int(h[0]) - 1)
        extra = [*others]
        if interact:
            extra.append(extra[-1] * x)
        fit = series.newey_west_ols(y, np.stack([np.ones(len(x)), x, *extra], 1), lags)
        inter = (float(fit.coefficients[-1]), float(fit.p_values[-1])) if interact else (None, None)
        return float(fit.coefficients[1]), float(fit.standard_errors[1]), float(fit.p_values[1]), *fit.confidence_interval(1), *inter, len(x), lags

    schema = "slope double, standard_error double, p_value double, ci_low double, ci_high double, interaction double, interaction_p double, n_obs int, lags int"
    return per_group(long, ["h"], kernel, schema, columns=("x", "y", "h_", *used[2:]))


def factor_assessment(df: DataFrame, by: list[str]) -> DataFrame:
    """Correlation with its interval, the slope in units of y per x, and the lag-one persistence of y."""

    def kernel(x, y):
        c = series.correlation_hac(x, y)
        return c.correlation, c.ci_low, c.ci_high, c.p_value, c.correlation * float(y.std(ddof=1) / x.std(ddof=1)), float(series.autocorrelations(y, 1)[0]), c.n_obs

    return per_group(df, by, kernel, "correlation double, ci_low double, ci_high double, p_value double, slope double, ar1 double, n_obs int")


def level_control(df: DataFrame, by: list[str]) -> DataFrame:
    """Slope of y on x with the level z held."""

    def kernel(x, y, z):
        fit = series.newey_west_ols(series.standardise(y), np.stack([np.ones(len(x)), series.standardise(x), series.standardise(z)], 1), series.newey_west_bandwidth(len(x)))
        return float(fit.coefficients[1]), float(fit.standard_errors[1]), float(fit.p_values[1]), fit.r_squared

    return per_group(df, by, kernel, "slope double, standard_error double, p_value double, r_squared double", columns=("x", "y", "z"))


def bandwidth_sensitivity(df: DataFrame, lags: list[int]) -> DataFrame:
    """lags, correlation (the same throughout), standard_error, p_value."""
    spark = df.sparkSession
    specs = F.broadcast(spark.createDataFrame([(k,) for k in lags], "bandwidth int"))

    def kernel(x, y, k):
        fit = series.newey_west_ols(series.standardise(y), np.stack([np.ones(len(x)), series.standardise(x)], 1), int(k[0]))
        return float(fit.coefficients[1]), float(fit.standard_errors[1]), float(fit.p_values[1])

    return per_group(df.crossJoin(specs).withColumn("k", F.col("bandwidth")), ["bandwidth"], kernel, "correlation double, standard_error double, p_value double", columns=("x", "y", "k"))


def sign_test(df: DataFrame, as_expected: str) -> DataFrame:
    """positive, n, p: the exact one-sided test that signs come out as expected."""

    @F.pandas_udf("double")
    def p(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([coders.sign_test(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    return df.agg(F.count_if(as_expected).alias("positive"), F.count(as_expected).alias("n")).withColumn("p", p("positive", "n"))


def holm_count(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """How many hypotheses the step-down procedure rejects: those before the first that fails."""
    w = Window.orderBy(F.col(p).asc_nulls_last())
    rows = df.where(F.col(p).isNotNull()).withColumn("_fails", (F.col(p) * (F.count(p).over(Window.partitionBy()) - F.row_number().over(w) + 1) > alpha).cast("int"))
    rows = rows.withColumn("_failed", F.max("_fails").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.agg(F.count_if(F.col("_failed") == 0).alias("n_rejected"), F.count("*").alias("n_tests"))


def require_reproduced(now: DataFrame, stored: DataFrame, keys: list[str], value: str, tolerance: float = 1e-10) -> None:
    """Stored values come out again."""
    from . import quality

    both = now.select(*keys, F.col(value).alias("_now")).join(stored.select(*keys, F.col(value).alias("_then")), keys, "full")
    quality.require_none(both, ~F.coalesce(F.abs(F.col("_now") - F.col("_then")) <= tolerance, F.col("_now").isNull() & F.col("_then").isNull()), f"{value} is not what was stored")


def spec_counts(results: DataFrame, by: list[str], p: str = "p_value") -> DataFrame:
    """How many specifications there are of each kind, how many were estimated and how many are significant at 5%."""
    return results.groupBy(*by).agg(F.count("*").alias("n_specs"), F.count(p).alias("n_estimated"), F.count_if(F.col(p) < 0.05).alias("n_significant"))

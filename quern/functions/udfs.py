"""Kernels as SQL functions, for sessions that work in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import coders, series, text


def _pair(values: list[tuple[float, float]]) -> pd.DataFrame:
    return pd.DataFrame(values, columns=["low", "high"])


def register(spark: SparkSession) -> None:
    """clopper_pearson(k, n), t_pvalue(t, df), incomplete_beta(a, b, x), binomial_cdf(k, n, p), sign_test(k, n); aggregates cohen_kappa(a, b) and correlation_t(x, y); table function section_diff(old, new)."""

    def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return _pair([coders.clopper_pearson_ci(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([series.two_sided_t_pvalue(float(a), float(b)) for a, b in zip(t, df, strict=True)])

    def incomplete_beta(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([series.regularised_incomplete_beta(float(p), float(q), float(r)) for p, q, r in zip(a, b, x, strict=True)])

    def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([coders.binomial_cdf(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])

    def sign_test(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([coders.sign_test(int(a), int(b)) for a, b in zip(k, n, strict=True)])

    def cohen_kappa(a: pd.Series, b: pd.Series) -> float:
        return coders.cohen_kappa(a, b, [-1, 0, 1])[1]

    def correlation_p(x: pd.Series, y: pd.Series) -> float:
        return series.correlation_effective_n(x.to_numpy(), y.to_numpy()).p_value

    scalar = {"clopper_pearson": (clopper_pearson, "low double, high double"), "t_pvalue": (t_pvalue, "double"), "incomplete_beta": (incomplete_beta, "double"), "binomial_cdf": (binomial_cdf, "double"), "sign_test": (sign_test, "double"), "cohen_kappa": (cohen_kappa, "double"), "correlation_p": (correlation_p, "double")}
    for name, (function, kind) in scalar.items():
        spark.udf.register(name, F.pandas_udf(function, kind))

    @F.udtf(returnType="section string, change string, line string")
    class SectionDiff:
        def eval(self, old: str, new: str):
            yield from text.section_diff(old or "", new or "")

    spark.udtf.register("section_diff", SectionDiff)

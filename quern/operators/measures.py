"""Calendar series of coded texts: attention, outlook, dispersion, polarisation, coverage, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality, relational

#: Short names of the topics, and which have an outlook.
TOPICS = {"pi": "inflation_attention", "y": "growth_attention", "fs": "financial_stability_attention", "unc": "uncertainty_attention"}
OUTLOOKS = {"pi": "inflation_outlook", "y": "growth_outlook"}
SPARSE = 3
PERIODS = {"month": "yyyy-MM", "quarter": None, "year": "yyyy"}


def share(att: Column) -> Column:
    return F.avg(att.cast("double"))


def volume(att: Column) -> Column:
    return F.sum(att).cast("long")


def outlook(att: Column, out: Column) -> Column:
    """Attention-weighted mean outlook; null without attention."""
    return F.try_divide(F.sum(att * out).cast("double"), F.sum(att))


def dispersion(att: Column, out: Column) -> Column:
    """Standard deviation of the outlook among attending rows; null below two."""
    return F.stddev_samp(F.when(att == 1, out.cast("double")))


def polarisation(att: Column, out: Column) -> Column:
    """2 min(up, down) / (up + down) among attending rows; null without either."""
    up, down = F.count_if((att == 1) & (out == 1)), F.count_if((att == 1) & (out == -1))
    return F.try_divide(2 * F.least(up, down).cast("double"), up + down)


def direction_share(att: Column, out: Column, sign: int) -> Column:
    return F.avg(F.when(att == 1, (out == sign).cast("double")))


def label(date: Column, freq: str) -> Column:
    if freq == "quarter":
        return F.concat(F.year(date), F.lit("Q"), F.quarter(date))
    return F.date_format(date, PERIODS[freq])


def period_start(date: Column, freq: str) -> Column:
    return F.to_date(F.trunc(F.to_date(date), freq))


def corrected(share_: Column, sensitivity: float | Column, specificity: float | Column) -> Column:
    """The true share behind an observed one, within [0, 1]; as it is where the rates tell nothing; null stays null."""
    sens, spec = (x if isinstance(x, Column) else F.lit(float(x)) for x in (sensitivity, specificity))
    gain = sens + spec - 1
    right = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(share_ - (1 - spec), gain)))
    return F.when(share_.isNotNull(), F.when(gain > 1e-6, right).otherwise(share_))


def aggregate(panel: DataFrame, freq: str, date: str = "date", speaker: str | None = "speakers", words: str | None = "n_words", truncated: str | None = None, topics: dict[str, str] | None = None, outlooks: dict[str, str] | None = None, rates: dict[str, tuple[float, float]] | None = None, prefix: str = "") -> DataFrame:
    """All measures by month, quarter or year, in one partial-aggregated pass."""
    topics, outlooks = TOPICS if topics is None else topics, OUTLOOKS if outlooks is None else outlooks
    when = F.col(date)
    cols = [F.count("*").alias("n_speeches")]
    if speaker:
        cols.append(F.countDistinct(speaker).alias("n_speakers"))
    if words:
        cols.append(F.avg(F.when(F.col(words) > 0, F.ln(words))).alias("mean_log_words"))
    if truncated:
        cols.append(F.avg(F.col(truncated).cast("double")).alias("share_truncated"))
    for k, v in topics.items():
        cols += [share(F.col(prefix + v)).alias(f"att_{k}"), volume(F.col(prefix + v)).alias(f"vol_{k}")]
    for k, v in outlooks.items():
        a, o = F.col(prefix + topics[k]), F.col(prefix + v)
        cols += [outlook(a, o).alias(f"out_{k}"), dispersion(a, o).alias(f"disp_{k}"), polarisation(a, o).alias(f"polar_{k}"), direction_share(a, o, 1).alias(f"share_up_{k}"), direction_share(a, o, -1).alias(f"share_down_{k}")]
    out = panel.where(when.isNotNull()).groupBy(label(when, freq).alias("period"), period_start(when, freq).alias("period_start")).agg(*cols)
    for k, (sens, spec) in (rates or {}).items():
        out = out.withColumn(f"att_{k}_corr", corrected(F.col(f"att_{k}"), sens, spec))
    return out.withColumn("sparse", F.col("n_speeches") < SPARSE)


def all_frequencies(panel: DataFrame, date: str, att: str, out: str) -> DataFrame:
    """Month, quarter and year in one scan, by grouping sets."""
    base = panel.where(F.col(date).isNotNull()).select(*[label(F.col(date), f).alias(f"_{f}") for f in PERIODS], F.col(att).alias("_a"), F.col(out).alias("_o"))
    a, o = F.col("_a"), F.col("_o")
    grouped = base.groupingSets([["_month"], ["_quarter"], ["_year"]], "_month", "_quarter", "_year").agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), share(a).alias("att"), outlook(a, o).alias("out"))
    freq = F.when(F.col("_g") == 3, "month").when(F.col("_g") == 5, "quarter").otherwise("year")
    return grouped.select(freq.alias("freq"), F.coalesce("_month", "_quarter", "_year").alias("period"), "n", "att", "out")


def reindex_calendar(measures: DataFrame, freq: str) -> DataFrame:
    """Every period between the first and the last; counts of added ones are 0, and they are sparse."""
    months = {"month": 1, "quarter": 3, "year": 12}[freq]
    ends = measures.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {months} months"))).alias("period_start"))
    counts = [c for c in measures.columns if c in ("n_speeches", "n_speakers") or c.startswith("vol_")]
    out = spine.join(measures.drop("period"), "period_start", "left").fillna(0, counts)
    return out.withColumn("period", label(F.col("period_start"), freq)).withColumn("sparse", F.col("n_speeches") < SPARSE).select(*measures.columns)


def weighted_equals_conditional(panel: DataFrame, att: str, out: str, tolerance: float = 1e-12) -> None:
    """The weighted outlook is the mean outlook of attending rows."""
    a, o = F.col(att), F.col(out)
    r = panel.agg(outlook(a, o).alias("w"), F.avg(F.when(a == 1, o.cast("double"))).alias("c")).first()
    quality.require((r["w"] is None and r["c"] is None) or abs(r["w"] - r["c"]) <= tolerance, f"weighted {r['w']} and conditional {r['c']} outlook differ")


def instrument_shares(df: DataFrame, freq: str, date: str, prefix: str, topics: dict[str, str] | None = None, outlooks: dict[str, str] | None = None) -> DataFrame:
    """Attention of all rows and outlook of attending rows, for the codes of one instrument."""
    topics, outlooks = topics or TOPICS, outlooks or OUTLOOKS
    cols = [share(F.col(prefix + v)).alias(f"att_{k}") for k, v in topics.items()] + [outlook(F.col(prefix + topics[k]), F.col(prefix + v)).alias(f"out_{k}") for k, v in outlooks.items()]
    return df.where(F.col(date).isNotNull()).groupBy(label(F.col(date), freq).alias("period")).agg(*cols)


def summary(measures: DataFrame, names: list[str]) -> DataFrame:
    """variable, mean, sd, min, max."""
    long = measures.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "variable", "value")
    return long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))


def length_trend(panel: DataFrame, date: str, words: str) -> DataFrame:
    """By year: texts, mean length, decline from the longest year, and whether it is the shortest (first of ties)."""
    years = panel.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"), F.avg(words).alias("mean_words"))
    all_ = Window.partitionBy()
    shortest = F.min_by("year", F.struct("mean_words", "year")).over(all_)
    return years.withColumn("decline", 1 - F.col("mean_words") / F.max("mean_words").over(all_)).withColumn("is_trough", F.col("year") == shortest)


def robustness(full: DataFrame, part: DataFrame, names: list[str], key: str = "period") -> DataFrame:
    """variable, r, n: correlation of each measure between two versions of the series."""
    joined = relational.join_suffixed(full.select(key, *names), part.select(key, *names), [key], ("_a", "_b"))
    cols = [c for n in names for c in (relational.correlation(F.col(f"{n}_a"), F.col(f"{n}_b")).alias(f"r_{n}"), F.count_if(F.col(f"{n}_a").isNotNull() & F.col(f"{n}_b").isNotNull()).alias(f"n_{n}"))]
    one = joined.agg(*cols)
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"r_{n}").alias("r"), F.col(f"n_{n}").alias("n")) for n in names])).alias("v")).select("v.*")


def correct_series(signals: DataFrame, variable: str, rates: tuple[float, float], by: list[str]) -> DataFrame:
    """n, raw and corrected share of a code by group."""
    out = signals.groupBy(*by).agg(F.count(variable).alias("n"), share(F.col(variable)).alias("raw"))
    return out.withColumn("corrected", corrected(F.col("raw"), *rates))


def corner_bounds(share_: Column, sens_ci: tuple[Column, Column], spec_ci: tuple[Column, Column]) -> dict[str, Column]:
    """Least and greatest corrected share at the corners of both intervals that tell something."""
    corners = F.array(*[F.when(s + p - 1 > 1e-6, corrected(share_, s, p)) for s in sens_ci for p in spec_ci])
    return {"low": F.array_min(corners), "high": F.array_max(corners)}


def recovered_rates(ppv: Column, npv: Column, q: Column) -> dict[str, Column]:
    """Sensitivity, specificity and prevalence from predictive values and the coded share; rates null where prevalence is 0 or 1."""
    p = q * ppv + (1 - q) * (1 - npv)
    inside = (p > 0) & (p < 1)
    return {"sensitivity": F.when(inside, F.try_divide(q * ppv, p)), "specificity": F.when(inside, F.try_divide((1 - q) * npv, 1 - p)), "prevalence": p}

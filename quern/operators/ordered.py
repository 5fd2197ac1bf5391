"""Ordered operators over period frames (some hundred rows), optionally by series.

A frame that is one series may stand in one task; with ``by`` series are dealt
out. Corpus-sized frames never come here unpartitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality


def over(order: str, by: list[str] | None = None):
    return Window.partitionBy(*(by or [])).orderBy(order)


def lead_difference(c: Column, h: int, w) -> Column:
    """Change over the next h periods; null at the end."""
    return F.lead(c, h).over(w) - c


def difference(c: Column, w, k: int = 1) -> Column:
    return c - F.lag(c, k).over(w)


def lagged_difference(c: Column, w, k: int = 1) -> Column:
    return F.lag(c, k).over(w) - F.lag(c, k + 1).over(w)


def running_total(c: Column, w) -> Column:
    """Cumulative sum that is null where the value is null."""
    return F.when(c.isNotNull(), F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def fill_forward(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def spine(df: DataFrame, period: str, step: str) -> DataFrame:
    """All periods from the first to the last, at steps such as ``1 day`` or ``3 months``."""
    return df.agg(F.min(period).alias("a"), F.max(period).alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias(period))


def on_calendar(df: DataFrame, period: str, step: str, zero: list[str] | None = None) -> DataFrame:
    """All periods; counts named in ``zero`` are 0 where a period had no row."""
    out = spine(df, period, step).join(df, period, "left")
    return out.fillna(0, zero) if zero else out


def daily(df: DataFrame, date: str, value: str, until: str | None = None) -> DataFrame:
    """A series of changes, carried forward onto every day."""
    quality.require_unique(df.select(date), [date])
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    stop = F.to_date(F.lit(until)) if until else F.col("b")
    days = ends.where("a is not null").select(F.explode(F.sequence("a", F.greatest(F.col("b"), stop), F.expr("interval 1 day"))).alias(date))
    return days.join(df.select(date, value), date, "left").withColumn(value, fill_forward(F.col(value), over(date)))


def quarter_start(c: Column) -> Column:
    return F.trunc(c, "quarter")


def quarter_label(c: Column) -> Column:
    return F.concat(F.year(c), F.lit("Q"), F.quarter(c))


def month_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def to_quarters(df: DataFrame, date: str, value: str, count: str) -> DataFrame:
    """Mean and number of observations by quarter; a repeated date is an error."""
    quality.require_unique(df.select(date), [date])
    return df.groupBy(quarter_start(F.col(date)).alias("period")).agg(F.avg(value).alias(value), F.count(value).alias(count))


def end_and_mean(df: DataFrame, date: str, value: str, until: str | None = None) -> DataFrame:
    """A series of changes by quarter: value at its last day, and mean over its days."""
    d = daily(df, date, value, until)
    return d.groupBy(quarter_start(F.col(date)).alias("period")).agg(F.max_by(value, date).alias(f"{value}_eop"), F.avg(value).alias(f"{value}_avg"))


def survey_rounds(df: DataFrame, target: str, variance: str, ahead: int, to: str) -> DataFrame:
    """Forecast variances by the quarter of the round, ``ahead`` quarters before their target: root of the round's mean, and its observations."""
    round_ = F.add_months(quarter_start(F.col(target)), -3 * ahead)
    return df.groupBy(round_.alias("period")).agg(F.sqrt(F.avg(variance)).alias(to), F.count(variance).alias(f"{to}_n_rounds"))


def events_by_quarter(events: DataFrame, date: str, factors: list[str]) -> DataFrame:
    """Each factor's sum by quarter, and its running total from its own first event on; quarters without an event inside a factor's span are an error."""
    sums = events.groupBy(quarter_start(F.col(date)).alias("period")).agg(*[F.sum(f).alias(f) for f in factors])
    full = on_calendar(sums, "period", "3 months")
    w = over("period")
    for f in factors:
        inside = F.sum(F.col(f).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0
        after = F.sum(F.col(f).isNotNull().cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing)) > 0
        full = full.withColumn(f"_{f}", inside & after & F.col(f).isNull())
    quality.require_none(full, F.greatest(*[F.col(f"_{f}").cast("int") for f in factors], F.lit(0)) == 1, "a factor has a quarter without events")
    return full.select("period", *factors, *[running_total(F.col(f), w).alias(f"{f}_cumulative") for f in factors])


def autocorrelation(df: DataFrame, order: str, value: str, lag: int = 1, by: list[str] | None = None) -> DataFrame:
    """Sample autocorrelation at one lag."""
    d = F.col(value) - F.avg(value).over(Window.partitionBy(*(by or [])))
    own = df.withColumn("_d", d)
    own = own.withColumn("_p", F.col("_d") * F.lag("_d", lag).over(over(order, by)))
    return own.groupBy(*(by or [])).agg(F.try_divide(F.sum("_p"), F.sum(F.col("_d") * F.col("_d"))).alias("acf"))


def peak_check(df: DataFrame, period: str, value: str) -> DataFrame:
    """peak (first of ties), peak_value, median, and whether the peak is twice the median or more."""
    one = df.agg(F.max_by(F.col(period), F.struct(F.col(value), F.negative(F.unix_date(F.to_date(F.col(period)))))).alias("peak"), F.max(value).alias("peak_value"), F.percentile(F.col(value), 0.5).alias("median"))
    return one.withColumn("stands_out", F.col("peak_value") >= 2 * F.col("median"))


def holm(df: DataFrame, p: str, by: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p values."""
    part = Window.partitionBy(*(by or []))
    order = part.orderBy(F.col(p).asc_nulls_last(), *[c for c in df.columns if c != p])
    scaled = F.least(F.lit(1.0), (F.count(p).over(part) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("_s", scaled).withColumn("p_holm", F.when(F.col(p).isNotNull(), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def bandwidth(n: Column) -> Column:
    """Automatic Newey-West bandwidth."""
    return F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0)))


def block_length(n: Column) -> Column:
    """Bootstrap block length, the cube root of n rounded up (exact cubes as they are)."""
    root = F.round(F.pow(n.cast("double"), F.lit(1.0 / 3.0)))
    return F.when(root * root * root == n, root).otherwise(F.ceil(F.pow(n.cast("double"), F.lit(1.0 / 3.0)))).cast("long")


def standardised(c: Column, by: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(by or []))
    return F.try_divide(c - F.avg(c).over(w), F.stddev_samp(c).over(w))

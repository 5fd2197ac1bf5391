"""Joins, set operations and shapes beyond what a single DataFrame call says."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy, in ranks over all, of the quantile that brackets an exact one.
BRACKET = 1e-4

from . import quality

#: Rows of a dimension that is sent to all executors in range joins.
SMALL_ROWS = 100_000


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join whose keys are unique on both sides, or an error."""
    quality.require_unique(left.select(*keys), keys)
    quality.require_unique(right.select(*keys), keys)
    return left.join(right, keys, how)


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Columns that both have, other than keys, get the suffixes."""
    both = set(left.columns) & set(right.columns) - set(keys)
    a, b = (df.select(*[F.col(f"`{c}`").alias(c + s if c in both else c) for c in df.columns]) for df, s in zip((left, right), suffixes, strict=True))
    return a.join(b, keys, how)


def align(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Full outer join of several frames on one key."""
    return reduce(lambda a, b: a.join(b, key, "full"), frames)


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def anti(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the ids; rows with a null key stay."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def lookup(df: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows of the given ids in the given order; a missing id is an error."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], f"_pos int, {key} {df.schema[key].dataType.simpleString()}")
    gone = [r[0] for r in wanted.join(df.select(key), key, "left_anti").select(key).collect()]
    quality.require(not gone, f"{key} has no rows for {gone}")
    return df.join(wanted, key).orderBy("_pos").drop("_pos")


def office_holders(df: DataFrame, date: str, terms: Sequence[tuple[str, str, str | None]], to: str) -> DataFrame:
    """The holder in office on a date: terms closed at both ends, the last may be open; a later term wins. A constant expression over few terms, no join."""
    holder = F.lit(None).cast("string")
    for name, start, end in terms:
        inside = F.col(date) >= F.to_date(F.lit(start))
        if end is not None:
            inside = inside & (F.col(date) <= F.to_date(F.lit(end)))
        holder = F.when(inside, F.lit(name)).otherwise(holder)
    return df.withColumn(to, holder)


def range_join(df: DataFrame, at: str, terms: DataFrame, start: str, end: str, order: str) -> DataFrame:
    """Left join to the term that holds ``at``: closed ends, null end open, the last by ``order`` wins.

    The terms become disjoint pieces first, so the join meets at most one piece
    a row and nothing has to be grouped afterwards; dates are bucketed by year
    for an equality key. Terms are a small frame (of offices, regimes): their
    pieces are made in one task. Rows of ``df`` may be any number.
    """
    columns = [c for c in terms.columns if c not in (start, end, order)]
    edges = terms.select(F.explode(F.array(F.col(start), F.date_add(F.coalesce(F.col(end), F.to_date(F.lit("9998-12-31"))), 1))).alias("_from")).distinct()
    pieces = edges.withColumn("_to", F.date_sub(F.lead("_from").over(Window.orderBy("_from")), 1)).where("_to is not null")
    held = pieces.join(terms, (F.col("_from") >= F.col(start)) & (F.col("_from") <= F.coalesce(F.col(end), F.to_date(F.lit("9998-12-31")))))
    won = held.groupBy("_from", "_to").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_w"))
    span = df.agg(F.year(F.min(at)).alias("a"), F.year(F.max(at)).alias("b")).first()
    if span["a"] is None:
        return df.join(won.select("_w.*"), F.lit(False), "left")
    years = F.sequence(F.greatest(F.year("_from"), F.lit(span["a"])), F.least(F.year("_to"), F.lit(span["b"])))
    bucketed = won.where((F.year("_from") <= span["b"]) & (F.year("_to") >= span["a"])).select(F.explode(years).alias("_year"), "_from", "_to", "_w")
    on = (F.year(df[at]) == F.col("_year")) & (df[at] >= F.col("_from")) & (df[at] <= F.col("_to"))
    return df.join(bucketed, on, "left").select(*[df[c] for c in df.columns], "_w.*")


def next_event(df: DataFrame, at: str, events: DataFrame, event_at: str, rank: str = "event_index", date: str = "event_date", start: str = "window_start") -> DataFrame:
    """Each row with the first event strictly after it: its index, its date, and the event before (null for the first). Rows after the last event go.

    Events become intervals [previous, own); rows and intervals meet on the
    month. Distinct event dates are numbered in one task, as a period frame is;
    rows of ``df`` may be any number.
    """
    order = Window.orderBy(event_at)
    spans = events.select(event_at).where(F.col(event_at).isNotNull()).distinct().select(F.col(event_at).alias(date), F.lag(event_at).over(order).alias(start), (F.row_number().over(order) - 1).alias(rank))
    first = df.agg(F.min(at)).first()[0]
    lo = F.coalesce(F.col(start), F.least(F.lit(first), F.col(date))) if first is not None else F.col(date)
    months = F.sequence(F.trunc(F.to_date(lo), "month"), F.trunc(F.to_date(F.col(date)), "month"), F.expr("interval 1 month"))
    keyed = spans.withColumn("_month", F.explode(months))
    on = (F.trunc(F.to_date(df[at]), "month") == F.col("_month")) & (df[at] < F.col(date)) & (F.col(start).isNull() | (df[at] >= F.col(start)))
    return df.join(keyed, on).drop("_month")


def splice(first: DataFrame, second: DataFrame, date: str, second_from: str, second_to: str | None = None) -> DataFrame:
    """``first``, but ``second`` from one date on and, optionally, up to before another. Of rows with one date the earlier part's wins."""
    inside = F.col(date) >= F.to_date(F.lit(second_from))
    if second_to:
        inside = inside & (F.col(date) < F.to_date(F.lit(second_to)))
    both = first.where(~inside).withColumn("_part", F.lit(0)).unionByName(second.where(inside).withColumn("_part", F.lit(1)))
    return first_rows(both, [date], ["_part"]).drop("_part")


def first_rows(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def set_difference(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in a, and only in b, as sets."""
    return a.subtract(b), b.subtract(a)


def unpivot_codes(df: DataFrame, ids: list[str], variables: list[str], to: str = "value") -> DataFrame:
    """Long form: ids, variable, value."""
    return df.unpivot(ids, variables, "variable", to)


def cross_specs(specs: DataFrame, data: DataFrame) -> DataFrame:
    """Each of a few specifications with all rows of a small frame."""
    return F.broadcast(specs).crossJoin(data)


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The commonest values, nulls among them; ties by value."""
    return df.groupBy(column).count().orderBy(F.desc("count"), F.col(column).asc_nulls_last()).limit(n)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """value, n, share; nulls left out."""
    each = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def describe(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear) and max."""
    c = F.col(column).cast("double")
    q = [F.percentile(c, p).alias(name) for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return df.groupBy(*(by or [])).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), *q, F.max(c).alias("max"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson over pairs without null; null where either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def pair_correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, r for all pairs of columns, from one pass."""
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    one = df.agg(*[correlation(F.col(x), F.col(y)).alias(f"{x}|{y}") for x, y in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs])).alias("p")).select("p.*")


def quantile(df: DataFrame, column: str | Column, p: float) -> float | None:
    """The exact quantile, linear between ranks, of any number of rows; nulls left out.

    An approximate quantile brackets the ranks asked for; only the values in
    the bracket (some ten thousandths of the rows) are counted and ordered.
    """
    c = F.col(column) if isinstance(column, str) else column
    rows = df.select(c.cast("double").alias("v")).where("v is not null")
    span = 2 * BRACKET
    n, (lo, hi) = rows.agg(F.count("*"), F.percentile_approx("v", [max(0.0, p - span), min(1.0, p + span)], int(1 / BRACKET))).first() if p is not None else (0, (None, None))
    if not n:
        return None
    at = (n - 1) * p
    wanted = (int(at), min(int(at) + 1, n - 1))
    below = rows.where(F.col("v") < lo).count() if p > span else 0
    inside = rows.where(F.col("v").between(lo if p > span else float("-inf"), hi if p + span < 1 else float("inf"))).groupBy("v").count()
    upto = inside.withColumn("upto", F.sum("count").over(Window.orderBy("v")) + below)
    got = [upto.where(F.col("upto") > k).agg(F.min("v")).first()[0] for k in wanted]
    if None in got or not below <= wanted[0]:
        return rows.agg(F.percentile("v", p)).first()[0]  # the bracket missed, which its accuracy rules out
    return got[0] + (at - int(at)) * (got[1] - got[0])


def by_magnitude(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Largest absolute value first, nulls last."""
    return df.orderBy(F.abs(F.col(column)).desc_nulls_last(), *ties)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A fixed random order."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)

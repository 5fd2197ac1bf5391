"""Gates: checks that raise, and check tables that tell."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class GateError(ValueError):
    """A data-quality gate found something."""


def require(ok: bool, what: str) -> None:
    if not ok:
        raise GateError(what)


def outcomes(spark: SparkSession, gates: dict[str, Callable[[], object]]) -> DataFrame:
    """gate, passed: each of the gates tried in turn, for a report on all of them. Other errors than a gate's go through."""
    rows = []
    for name, gate in gates.items():
        try:
            gate()
            rows.append((name, True))
        except GateError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "gate string, passed boolean")


def require_columns(df: DataFrame, names: list[str], exact: bool = False) -> DataFrame:
    missing, extra = sorted(set(names) - set(df.columns)), sorted(set(df.columns) - set(names))
    require(not missing and not (exact and extra), f"missing columns {missing}, unexpected columns {extra if exact else []}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """No two rows share the key; nulls count as equal. One aggregation, stops at the first found."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    require(not twice, f"rows share the key {twice[0].asDict() if twice else ''}")
    return df


def require_none(df: DataFrame, wrong: Column, what: str) -> DataFrame:
    """No row for which ``wrong`` is true."""
    found = df.where(wrong).limit(1).collect()
    require(not found, f"{what}: {found[0].asDict() if found else ''}")
    return df


def require_between(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return require_none(df, ~F.col(column).between(low, high), f"{column} outside [{low}, {high}]")


def require_matched(df: DataFrame, column: str) -> DataFrame:
    return require_none(df, F.col(column).isNull(), f"{column} has no match")


def require_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.count(), after.count()
    require(a == b, f"the join turned {a} rows into {b}")
    return after


def require_first(df: DataFrame, column: str, first) -> DataFrame:
    found = df.agg(F.min(column)).first()[0]
    require(found == first, f"{column} begins at {found}, not {first}")
    return df


def require_names(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Every one of the names occurs."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], f"{column} string")
    gone = [r[0] for r in wanted.join(df.select(column).distinct(), column, "left_anti").collect()]
    require(not gone, f"{column} never has {sorted(gone)}")
    return df


def require_gap_free(df: DataFrame, period: str, months: int) -> DataFrame:
    """Periods follow one another, every ``months`` months."""
    ends = df.agg(F.min(period).alias("a"), F.max(period).alias("b"), F.countDistinct(period).alias("n"), F.count("*").alias("rows")).first()
    expected = df.sparkSession.range(1).select(F.size(F.sequence(F.lit(ends["a"]), F.lit(ends["b"]), F.expr(f"interval {months} months"))).alias("n")).first()["n"] if ends["n"] else 0
    require(ends["n"] == expected == ends["rows"], f"{period}: {ends['rows']} rows, {ends['n']} periods, {expected} expected")
    return df


def check_table(df: DataFrame, checks: dict[str, Column], n_rows: int | None = None) -> DataFrame:
    """check, ok, n_wrong: for each named condition the rows for which it isn't true, in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()], F.count("*").alias("_rows"))
    rows = [F.struct(F.lit(k).alias("check"), (F.col(f"`{k}`") == 0).alias("ok"), F.col(f"`{k}`").alias("n_wrong")) for k in checks]
    if n_rows is not None:
        rows.append(F.struct(F.lit("row_count").alias("check"), (F.col("_rows") == n_rows).alias("ok"), F.abs(F.col("_rows") - n_rows).alias("n_wrong")))
    return counts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def record_checks(attention: list[str], outlooks: dict[str, str]) -> dict[str, Column]:
    """Domains of coded records, and the rule that an outlook is 0 where its topic has no attention."""
    out = {f"{v}_domain": F.col(v).isin(0, 1) for v in attention}
    out |= {f"{v}_domain": F.col(v).isin(-1, 0, 1) for v in outlooks}
    out |= {f"{v}_needs_attention": (F.col(a) == 1) | (F.col(v) == 0) for v, a in outlooks.items()}
    return out


def null_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_null, share_null."""
    names = columns or df.columns
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_null"), F.try_divide(F.col(f"`{c}`"), F.col("_n")).alias("share_null")) for c in names])).alias("r")).select("r.*")


def duplicate_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_repeated (beyond the first of each key), n_involved (all rows of repeated keys)."""
    each = df.groupBy(*keys).agg(F.count("*").alias("k"))
    return each.agg(F.sum("k").alias("n_rows"), F.sum(F.col("k") - 1).alias("n_repeated"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_involved"))


def id_coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """side, key: ids of one side that the other lacks."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.exceptAll(b).select(F.lit("missing").alias("side"), key).unionByName(b.exceptAll(a).select(F.lit("unexpected").alias("side"), key))


def within_domain(df: DataFrame, column: str, domain: list) -> DataFrame:
    """ok, extra: whether the column's values are a subset of the domain."""
    seen = F.collect_set(column)
    extra = F.array_sort(F.array_except(seen, F.array(*map(F.lit, domain))))
    return df.agg(extra.alias("extra")).select((F.size("extra") == 0).alias("ok"), "extra")


def short_texts(df: DataFrame, words: str, least: int = 200) -> DataFrame:
    """Texts below so many words, shortest first."""
    return df.where(F.col(words) < least).orderBy(words, *[c for c in df.columns if c != words][:1])


def corpus_audit(raw: DataFrame, date: str, title: str, contents: str) -> dict[str, DataFrame]:
    """nulls by column, duplicates (all columns; date and title), lengths in characters and words, coverage by year with gaps."""
    from ..functions import text
    from . import relational

    lengths = raw.select(text.char_length(F.col(contents)).alias("chars"), text.word_count(F.col(contents)).alias("words"))
    years = raw.where(F.col(date).isNotNull()).groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n"))
    spine = years.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return {
        "nulls": null_audit(raw),
        "duplicates": duplicate_audit(raw, raw.columns).withColumn("keys", F.lit("all")).unionByName(duplicate_audit(raw, [date, title]).withColumn("keys", F.lit("date and title"))),
        "lengths": relational.describe(lengths, "chars").withColumn("unit", F.lit("characters")).unionByName(relational.describe(lengths, "words").withColumn("unit", F.lit("words"))),
        "years": spine.join(years, "year", "left").fillna(0, ["n"]),
    }


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))

"""Agreement of coders, and what their errors look like: native aggregations over long frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coders
from . import quality, relational


def categories(variable: Column) -> Column:
    return F.when(variable.endswith("_outlook"), F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0), F.lit(1)))


def kappa(a: Column, b: Column, cats: list[int]) -> dict[str, Column]:
    """agreement and kappa as aggregates; kappa is null where chance alone agrees always."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    observed = F.avg((x == y).cast("double"))
    chance = sum((F.avg((x == c).cast("double")) * F.avg((y == c).cast("double")) for c in cats), F.lit(0.0))
    return {"agreement": observed, "kappa": F.when(chance < 1, F.try_divide(observed - chance, 1 - chance))}


def long_pairs(df: DataFrame, ids: list[str], variables: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """ids, variable, a, b from columns variable + suffix."""
    a, b = suffixes
    rows = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v + a).cast("int").alias("a"), F.col(v + b).cast("int").alias("b")) for v in variables])
    return df.select(*ids, F.explode(rows).alias("_r")).select(*ids, "_r.*")


def agreement_table(pairs: DataFrame, by: list[str] | None = None, lenient: Column | None = None) -> DataFrame:
    """By variable: n, n_disagree, agreement, kappa; with ``lenient`` also the agreement that counts those rows as agreed."""
    k = kappa(F.col("a"), F.col("b"), [-1, 0, 1])  # a category that nobody uses adds nothing
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    cols = [F.count_if(both).alias("n"), F.count_if(both & (F.col("a") != F.col("b"))).alias("n_disagree"), k["agreement"].alias("agreement"), k["kappa"].alias("kappa")]
    if lenient is not None:
        cols.append(F.avg(F.when(both, ((F.col("a") == F.col("b")) | F.coalesce(lenient, F.lit(False))).cast("double"))).alias("agreement_lenient"))
    return pairs.groupBy(*(by or ["variable"])).agg(*cols)


def with_intervals(table: DataFrame, pairs: DataFrame, n_draws: int = coders.DRAWS, seed: int = coders.SEED) -> DataFrame:
    """The table with kappa's bootstrap interval and the exact interval of the agreement. A variable's task gets its cells (a, b) with their counts."""

    def run(pdf):
        pdf = pdf.sort_values(["a", "b"])
        v = pdf["variable"].iloc[0]
        lo, hi = coders.bootstrap_kappa_cells_ci(pdf["a"], pdf["b"], pdf["n"], coders.categories_for(v), n_draws, seed)
        low, high = coders.clopper_pearson_ci(int(pdf["n"][pdf["a"] == pdf["b"]].sum()), int(pdf["n"].sum()))
        return pd.DataFrame([(v, lo, hi, low, high)], columns=["variable", "kappa_low", "kappa_high", "agreement_low", "agreement_high"])

    cells = pairs.where("a is not null and b is not null").groupBy("variable", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).agg(F.count("*").alias("n"))
    found = cells.groupBy("variable").applyInPandas(run, "variable string, kappa_low double, kappa_high double, agreement_low double, agreement_high double")
    return table.join(null_not_nan(found), "variable", "left")


def null_not_nan(df: DataFrame) -> DataFrame:
    return df.select(*[F.nullif(F.col(c), F.lit(float("nan"))).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def confusion(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Candidate a against reference b, both 0 or 1: tp, fp, fn, tn, precision, recall, specificity."""
    n = {k: F.count_if((F.col("a") == x) & (F.col("b") == y)) for k, (x, y) in {"tp": (1, 1), "fp": (1, 0), "fn": (0, 1), "tn": (0, 0)}.items()}
    out = pairs.groupBy(*(by or ["variable"])).agg(*[c.alias(k) for k, c in n.items()])
    return out.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), "specificity": F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))})


def exact_intervals(df: DataFrame, k: str, n: str, low: str, high: str) -> DataFrame:
    """Clopper-Pearson bounds of k of n, null without trials."""

    @F.pandas_udf("low double, high double")
    def bounds(ks: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([coders.clopper_pearson_ci(int(a), int(b)) for a, b in zip(ks, ns, strict=True)], columns=["low", "high"])

    out = df.withColumn("_ci", bounds(F.col(k).cast("long"), F.col(n).cast("long")))
    return out.withColumns({low: F.nullif(F.col("_ci.low"), F.lit(float("nan"))), high: F.nullif(F.col("_ci.high"), F.lit(float("nan")))}).drop("_ci")


def rate_table(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By variable, candidate a against reference b, both 0 or 1: sensitivity and specificity with exact intervals, the coded share,
    the share corrected by the rates, and its least and greatest at the corners of the two intervals that tell something."""
    from . import measures

    c = confusion(pairs, by).withColumnRenamed("recall", "sensitivity").withColumns({"n_true_one": F.col("tp") + F.col("fn"), "n_true_zero": F.col("tn") + F.col("fp")})
    c = exact_intervals(exact_intervals(c, "tp", "n_true_one", "sens_low", "sens_high"), "tn", "n_true_zero", "spec_low", "spec_high")
    c = c.withColumn("coded_share", F.try_divide((F.col("tp") + F.col("fp")).cast("double"), F.col("n_true_one") + F.col("n_true_zero")))
    bounds = measures.corner_bounds(F.col("coded_share"), (F.col("sens_low"), F.col("sens_high")), (F.col("spec_low"), F.col("spec_high")))
    c = c.withColumns({"corrected": measures.corrected(F.col("coded_share"), F.col("sensitivity"), F.col("specificity")), "corrected_low": bounds["low"], "corrected_high": bounds["high"]})
    rates = ["sensitivity", "sens_low", "sens_high", "specificity", "spec_low", "spec_high", "coded_share", "corrected", "corrected_low", "corrected_high"]
    return c.select(*(by or ["variable"]), "n_true_one", "n_true_zero", *rates)


def outlook_errors(wide: DataFrame, att: tuple[str, str], out: tuple[str, str], id_col: str, strict_reversal: bool = True) -> DataFrame:
    """What outlook disagreements are: forced by attention, independent of it, a direction against neutral, reversed signs. Their ids are in ``outlook_error_rows``.

    ``strict_reversal``: opposite signs only; otherwise any two different codes that aren't 0.
    """
    a, b, x, y = F.col(att[0]), F.col(att[1]), F.col(out[0]), F.col(out[1])
    wrong = x != y
    apart = F.signum(x.cast("double")) * F.signum(y.cast("double"))
    reversed_ = wrong & (apart < 0 if strict_reversal else apart != 0)
    same_att = a == b
    return wide.agg(
        F.count_if(wrong).alias("n_wrong"), F.count_if(wrong & ~same_att).alias("forced_by_attention"), F.count_if(wrong & same_att).alias("independent"),
        F.count_if(wrong & ((x == 0) | (y == 0))).alias("direction_to_neutral"), F.count_if(reversed_).alias("sign_reversals"),
    )


def outlook_error_rows(wide: DataFrame, att: tuple[str, str], out: tuple[str, str], id_col: str) -> DataFrame:
    """A row for each outlook disagreement: its id, kind (forced, independent), whether one side is neutral and whether signs are opposite. Nothing is gathered."""
    a, b, x, y = F.col(att[0]), F.col(att[1]), F.col(out[0]), F.col(out[1])
    kind = F.when(a == b, "independent").otherwise("forced")
    opposite = F.signum(x.cast("double")) * F.signum(y.cast("double")) < 0
    return wide.where(x != y).select(F.col(id_col), kind.alias("kind"), ((x == 0) | (y == 0)).alias("neutral"), opposite.alias("reversed"))


def pooled(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All cells together: n_cells, n_agree, agreement."""
    both = pairs.where("a is not null and b is not null")
    return both.groupBy(*(by or [])).agg(F.count("*").alias("n_cells"), F.count_if(F.col("a") == F.col("b")).alias("n_agree")).withColumn("agreement", F.try_divide(F.col("n_agree").cast("double"), F.col("n_cells")))


def base_rates(codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of cells that aren't 0 (variable, value): attention is 1, or the outlook has a direction."""
    return codes.where("value is not null").groupBy(*(by or ["variable"])).agg(F.count("*").alias("n"), F.avg((F.col("value") != 0).cast("double")).alias("rate"))


def horse_race(cells: DataFrame) -> DataFrame:
    """By variable and instrument (columns variable, instrument, code, human): n, agreement, kappa."""
    return agreement_table(cells.withColumnsRenamed({"code": "a", "human": "b"}), ["variable", "instrument"])


def error_overlap(df: DataFrame, a: str, b: str, truth: str, id_col: str) -> DataFrame:
    """kind (FP, FN), only_a, only_b, shared: sorted ids of two instruments' errors, for a report on a small sample; ``error_rows`` is for any number."""

    def ids(code: str, wrong: int) -> Column:
        return F.collect_set(F.when((F.col(code) == wrong) & (F.col(truth) == 1 - wrong), F.col(id_col)))

    one = df.agg(*[ids(c, w).alias(f"{n}{w}") for n, c in (("a", a), ("b", b)) for w in (1, 0)])
    join = lambda c: F.array_join(F.array_sort(c), " ")
    kinds = [F.struct(F.lit(k).alias("kind"), join(F.array_except(f"a{w}", f"b{w}")).alias("only_a"), join(F.array_except(f"b{w}", f"a{w}")).alias("only_b"), join(F.array_intersect(f"a{w}", f"b{w}")).alias("shared")) for k, w in (("FP", 1), ("FN", 0))]
    return one.select(F.explode(F.array(*kinds)).alias("k")).select("k.*")


def error_rows(df: DataFrame, a: str, b: str, truth: str, id_col: str) -> DataFrame:
    """A row for each erring id: kind (FP, FN), side (only_a, only_b, shared) of two instruments' errors. Nothing is gathered."""
    wrong = lambda c: F.coalesce(F.col(c) == 1 - F.col(truth), F.lit(False))
    side = F.when(wrong(a) & wrong(b), "shared").when(wrong(a), "only_a").when(wrong(b), "only_b")
    kind = F.when(F.col(truth) == 0, "FP").when(F.col(truth) == 1, "FN")
    rows = df.select(kind.alias("kind"), side.alias("side"), F.col(id_col)).where("kind is not null and side is not null")
    return rows.distinct()


def split_effects(pairs: DataFrame, group: str) -> DataFrame:
    """Agreement of the same cells on treated and control texts, by variable, and their difference."""
    ok = (F.col("a") == F.col("b")).cast("double")
    out = pairs.groupBy("variable").agg(F.avg(F.when(F.col(group), ok)).alias("treated"), F.avg(F.when(~F.col(group), ok)).alias("control"), F.count_if(F.col(group)).alias("n_treated"), F.count_if(~F.col(group)).alias("n_control"))
    return out.withColumn("effect", F.col("treated") - F.col("control"))


def ceiling(now: DataFrame, before: DataFrame) -> DataFrame:
    """An agreement table next to an earlier round's, with the change of kappa."""
    old = before.select("variable", F.col("agreement").alias("agreement_before"), F.col("kappa").alias("kappa_before"))
    return now.join(old, "variable", "left").withColumn("kappa_change", F.col("kappa") - F.col("kappa_before"))


def sample_against_frame(frame: DataFrame, sampled: str, codes: list[str]) -> DataFrame:
    """variable, in_sample, outside, all: rates of codes that aren't 0."""
    def rate(v: str, where: Column) -> Column:
        return F.avg(F.when(where, (F.col(v) != 0).cast("double")))

    one = frame.agg(*[rate(v, w).alias(f"{v}|{k}") for v in codes for k, w in (("in_sample", F.col(sampled)), ("outside", ~F.col(sampled)), ("all", F.lit(True)))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), *[F.col(f"`{v}|{k}`").alias(k) for k in ("in_sample", "outside", "all")]) for v in codes])).alias("r")).select("r.*")


def triage(pairs: DataFrame, id_col: str, flags: str | None = None) -> DataFrame:
    """Texts with contested cells: which, how many, and a priority: high from three on or with an outlook reversed, low for one flagged as borderline."""
    wrong = pairs.where("a is not null and b is not null and a <> b")
    cell = F.concat(F.col("variable"), F.lit(":"), F.format_string("%+d", "a"), F.lit("/"), F.format_string("%+d", "b"))
    own = wrong.groupBy(id_col).agg(F.count("*").alias("n_contested"), F.array_join(F.array_sort(F.collect_list(cell)), "; ").alias("cells"), F.bool_or(F.col("a") * F.col("b") == -1).alias("reversed"), *([F.bool_and(F.col(flags)).alias("all_flagged")] if flags else []))
    low = F.col("all_flagged") if flags else F.lit(False)
    priority = F.when((F.col("n_contested") >= 3) | F.col("reversed"), "high").when((F.col("n_contested") == 1) & low, "low").otherwise("medium")
    return own.withColumn("priority", priority)


def adjudication(pairs: DataFrame, id_col: str, truncated: str, variables: list[str] | None = None) -> DataFrame:
    """A row for each contested cell, in order of priority: 10 for a cut text plus the variable's rank."""
    names = variables or coders.VARIABLES
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("variable"))
    wrong = pairs.where("a is not null and b is not null and a <> b")
    return wrong.withColumn("priority", (10 * F.col(truncated).cast("int") + rank).cast("int")).orderBy(F.desc("priority"), id_col, "variable")


def truncation_diagnostic(pairs: DataFrame, words: str, seen: int) -> DataFrame:
    """Errors on cut and whole texts, and quartiles of the words a coder didn't see."""
    cut, wrong = F.col(words) > seen, F.col("a") != F.col("b")
    held = F.when(cut, F.col(words) - seen).cast("double")
    return pairs.agg(F.count_if(cut).alias("n_cut"), F.count_if(~cut).alias("n_whole"), F.count_if(cut & wrong).alias("wrong_cut"), F.count_if(~cut & wrong).alias("wrong_whole"), *[F.percentile(held, p).alias(f"held_p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])


def require_flags_consistent(rows: DataFrame, a: str, b: str, flag: str) -> DataFrame:
    """No cell is marked as agreed though its codes differ."""
    return quality.require_none(rows, (F.col(flag) == "agree") & (F.col(a) != F.col(b)), "marked as agreed, but the codes differ")


# Calibration of scores to codes


def threshold_at_prevalence(scores: DataFrame, score: str, rate: float) -> float:
    """The score that a share of ``rate`` exceeds, linear between ranks."""
    quality.require(0 < rate < 1, f"rate {rate} is not inside (0, 1)")
    return relational.quantile(scores, score, 1 - rate)


def code_attention(rows: DataFrame, score: str, rate: float, to: str, baseline: Column | None = None) -> DataFrame:
    """1 where the score is above the cutoff that gives ``rate`` on the baseline rows (all, by default)."""
    cutoff = threshold_at_prevalence(rows if baseline is None else rows.where(baseline), score, rate)
    return rows.withColumn(to, (F.col(score) > F.lit(cutoff)).cast("int"))


def code_outlook(rows: DataFrame, tone: str, attention: str, neutral_rate: float, to: str) -> DataFrame:
    """The tone's sign; 0 without attention and inside a band that makes the share of zeros ``neutral_rate``."""
    attending = F.col(attention) == 1
    share = rows.agg(F.avg(attending.cast("double"))).first()[0]
    quality.require(bool(share), "no row attends")
    left = neutral_rate - (1 - share)
    band = 0.0 if left <= 0 else relational.quantile(rows.where(attending), F.abs(F.col(tone).cast("double")), min(left / share, 1.0))
    return rows.withColumn(to, F.when(attending & (F.abs(F.col(tone)) > F.lit(band)), F.signum(F.col(tone).cast("double")).cast("int")).otherwise(0))


def restricted(pairs: DataFrame, id_col: str, attention: list[str], least: int = 3) -> DataFrame:
    """Texts to which coder a gives at least so many topics."""
    n = F.sum(F.when(F.col("variable").isin(attention), F.col("a")).otherwise(0)).over(Window.partitionBy(id_col))
    return pairs.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")

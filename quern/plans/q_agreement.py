"""Agreement of two coders of the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, measures
from .catalogue import PANEL_SQL, panel, query, r6, table

_LONG = f"(SELECT o_orderkey, o_custkey, 'att' AS variable, att AS a, att_b AS b FROM {PANEL_SQL} UNION ALL SELECT o_orderkey, o_custkey, 'outl', outl, outl_b FROM {PANEL_SQL})"


def _pairs(spark, sf_dir):
    p = panel(spark, sf_dir).withColumnsRenamed({"att": "att_a", "outl": "outl_a"})
    return agreement.long_pairs(p, ["o_orderkey", "o_custkey"], ["att", "outl"], ("_a", "_b"))


def _kappa_sql(where: str) -> str:
    return f"""SELECT variable, n, n_disagree, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT variable, count(*)::BIGINT AS n, count(*) FILTER (a <> b)::BIGINT AS n_disagree, avg((a = b)::INT::DOUBLE) AS po,
 avg((a = -1)::INT::DOUBLE) * avg((b = -1)::INT::DOUBLE) + avg((a = 0)::INT::DOUBLE) * avg((b = 0)::INT::DOUBLE) + avg((a = 1)::INT::DOUBLE) * avg((b = 1)::INT::DOUBLE) AS pe FROM {_LONG} WHERE {where} GROUP BY 1)"""


def _kappa(pairs):
    return agreement.agreement_table(pairs).select("variable", "n", "n_disagree", r6(F.col("agreement")).alias("agreement"), r6(F.col("kappa")).alias("kappa"))


@query(_kappa_sql("variable = 'att'"))
def kappa_binary(spark, sf_dir):
    return _kappa(_pairs(spark, sf_dir).where("variable = 'att'"))


@query(_kappa_sql("variable = 'outl'"))
def kappa_ternary(spark, sf_dir):
    return _kappa(_pairs(spark, sf_dir).where("variable = 'outl'"))


@query(f"SELECT variable, round(avg((a = b)::INT::DOUBLE), 6) AS agreement, round(avg((a = b OR o_custkey % 3 = 0)::INT::DOUBLE), 6) AS agreement_lenient FROM {_LONG} GROUP BY 1")
def lenient_agreement(spark, sf_dir):
    out = agreement.agreement_table(_pairs(spark, sf_dir), lenient=F.col("o_custkey") % 3 == 0)
    return out.select("variable", r6(F.col("agreement")).alias("agreement"), r6(F.col("agreement_lenient")).alias("agreement_lenient"))


_COUNTS = f"(SELECT count(*) FILTER (att = 1 AND att_b = 1)::BIGINT AS tp, count(*) FILTER (att = 1 AND att_b = 0)::BIGINT AS fp, count(*) FILTER (att = 0 AND att_b = 1)::BIGINT AS fn, count(*) FILTER (att = 0 AND att_b = 0)::BIGINT AS tn FROM {PANEL_SQL})"


@query(f"SELECT 'att' AS variable, tp, fp, fn, tn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(tn::DOUBLE / (tn + fp), 6) AS specificity FROM {_COUNTS}")
def confusion(spark, sf_dir):
    out = agreement.confusion(_pairs(spark, sf_dir).where("variable = 'att'"))
    return out.select("variable", "tp", "fp", "fn", "tn", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "specificity")])


@query("SELECT round(avg(CASE WHEN toxic = 1 THEN (quality = 1)::INT::DOUBLE END), 6) AS sensitivity, round(avg(CASE WHEN toxic = 0 THEN (quality = 0)::INT::DOUBLE END), 6) AS specificity, count(*) FILTER (toxic = 1)::BIGINT AS n_true_one, count(*) FILTER (toxic = 0)::BIGINT AS n_true_zero FROM labels")
def sens_spec(spark, sf_dir):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf_dir, "labels").agg(r6(F.avg(F.when(t == 1, (q == 1).cast("double")))).alias("sensitivity"), r6(F.avg(F.when(t == 0, (q == 0).cast("double")))).alias("specificity"), F.count_if(t == 1).alias("n_true_one"), F.count_if(t == 0).alias("n_true_zero"))


@query()
def sens_spec_intervals(spark, sf_dir):
    c = agreement.confusion(_pairs(spark, sf_dir).where("variable = 'att'")).withColumns({"p": F.col("tp") + F.col("fn"), "q": F.col("tn") + F.col("fp")})
    return agreement.exact_intervals(agreement.exact_intervals(c, "tp", "p", "recall_low", "recall_high"), "tn", "q", "specificity_low", "specificity_high").drop("p", "q")


@query(f"""WITH x AS (SELECT o_orderkey, att_b AS t, att AS a, CASE WHEN o_orderkey % 13 = 0 THEN 1 - att ELSE att END AS b FROM {PANEL_SQL})
 SELECT CASE t WHEN 0 THEN 'FP' ELSE 'FN' END AS kind, CASE WHEN a = b THEN 'shared' WHEN a <> t THEN 'only_a' ELSE 'only_b' END AS side, o_orderkey FROM x WHERE a <> t OR b <> t""")
def error_overlap(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("b", F.when(F.col("o_orderkey") % 13 == 0, 1 - F.col("att")).otherwise(F.col("att")))
    return agreement.error_rows(p, "att", "b", "att_b", "o_orderkey")


def _outlook_sql(reversal: str) -> str:
    return f"""SELECT count(*) FILTER (outl <> outl_b)::BIGINT AS n_wrong, count(*) FILTER (outl <> outl_b AND att <> att_b)::BIGINT AS forced_by_attention, count(*) FILTER (outl <> outl_b AND att = att_b)::BIGINT AS independent,
 count(*) FILTER (outl <> outl_b AND (outl = 0 OR outl_b = 0))::BIGINT AS direction_to_neutral, count(*) FILTER (outl <> outl_b AND {reversal})::BIGINT AS sign_reversals FROM {PANEL_SQL}"""


@query(_outlook_sql("outl * outl_b < 0"))
def outlook_decomposition(spark, sf_dir):
    return agreement.outlook_errors(panel(spark, sf_dir), ("att", "att_b"), ("outl", "outl_b"), "o_orderkey")


@query(_outlook_sql("outl * outl_b <> 0"))
def outlook_decomposition_loose(spark, sf_dir):
    return agreement.outlook_errors(panel(spark, sf_dir), ("att", "att_b"), ("outl", "outl_b"), "o_orderkey", False)


@query(f"SELECT o_orderkey, CASE WHEN att = att_b THEN 'independent' ELSE 'forced' END AS kind, outl = 0 OR outl_b = 0 AS neutral, outl * outl_b < 0 AS reversed FROM {PANEL_SQL} WHERE outl <> outl_b")
def outlook_error_rows(spark, sf_dir):
    return agreement.outlook_error_rows(panel(spark, sf_dir), ("att", "att_b"), ("outl", "outl_b"), "o_orderkey")


@query(f"SELECT count(*)::BIGINT AS n_cells, count(*) FILTER (a = b)::BIGINT AS n_agree, round(avg((a = b)::INT::DOUBLE), 6) AS agreement FROM {_LONG}")
def pooled_cells(spark, sf_dir):
    return agreement.pooled(_pairs(spark, sf_dir)).select("n_cells", "n_agree", r6(F.col("agreement")).alias("agreement"))


@query(f"SELECT variable, count(*)::BIGINT AS n, round(avg((a <> 0)::INT::DOUBLE), 6) AS rate FROM {_LONG} GROUP BY 1")
def base_rates(spark, sf_dir):
    return agreement.base_rates(_pairs(spark, sf_dir).withColumnRenamed("a", "value")).select("variable", "n", r6(F.col("rate")).alias("rate"))


@query(f"SELECT variable, round(avg((a = b)::INT::DOUBLE) FILTER (o_custkey % 4 = 0), 6) AS treated, round(avg((a = b)::INT::DOUBLE) FILTER (o_custkey % 4 <> 0), 6) AS control, count(*) FILTER (o_custkey % 4 = 0)::BIGINT AS n_treated, count(*) FILTER (o_custkey % 4 <> 0)::BIGINT AS n_control, round(avg((a = b)::INT::DOUBLE) FILTER (o_custkey % 4 = 0) - avg((a = b)::INT::DOUBLE) FILTER (o_custkey % 4 <> 0), 6) AS effect FROM {_LONG} GROUP BY 1")
def coder_text_split(spark, sf_dir):
    out = agreement.split_effects(_pairs(spark, sf_dir).withColumn("g", F.col("o_custkey") % 4 == 0), "g")
    return out.select("variable", "n_treated", "n_control", *[r6(F.col(c)).alias(c) for c in ("treated", "control", "effect")])


@query(f"""SELECT o_orderkey, n AS n_contested, cells, CASE WHEN n >= 3 OR rev THEN 'high' WHEN n = 1 AND flagged THEN 'low' ELSE 'medium' END AS priority FROM (SELECT o_orderkey, count(*)::BIGINT AS n, string_agg(c, '; ' ORDER BY c) AS cells, bool_or(a * b = -1) AS rev, bool_and(o_custkey % 2 = 0) AS flagged
 FROM (SELECT *, variable || ':' || printf('%+d', a) || '/' || printf('%+d', b) AS c FROM {_LONG} WHERE a <> b) GROUP BY 1)""")
def triage(spark, sf_dir):
    return agreement.triage(_pairs(spark, sf_dir).withColumn("f", F.col("o_custkey") % 2 == 0), "o_orderkey", "f").select("o_orderkey", "n_contested", "cells", "priority")


@query(f"SELECT o_orderkey, variable, a, b, (10 * (o_custkey % 3 = 0)::INT + CASE variable WHEN 'att' THEN 1 ELSE 2 END)::INT AS priority FROM {_LONG} WHERE a <> b")
def adjudication(spark, sf_dir):
    out = agreement.adjudication(_pairs(spark, sf_dir).withColumn("cut", F.col("o_custkey") % 3 == 0), "o_orderkey", "cut", ["att", "outl"])
    return out.select("o_orderkey", "variable", "a", "b", "priority")


@query(f"SELECT variable, round(avg((x <> 0)::INT::DOUBLE) FILTER (s), 6) AS in_sample, round(avg((x <> 0)::INT::DOUBLE) FILTER (NOT s), 6) AS outside, round(avg((x <> 0)::INT::DOUBLE), 6) AS all FROM (SELECT 'att' AS variable, att AS x, o_orderkey % 50 = 0 AS s FROM {PANEL_SQL} UNION ALL SELECT 'outl', outl, o_orderkey % 50 = 0 FROM {PANEL_SQL}) GROUP BY 1".replace(" AS all ", ' AS "all" '))
def sample_vs_frame(spark, sf_dir):
    out = agreement.sample_against_frame(panel(spark, sf_dir).withColumn("s", F.col("o_orderkey") % 50 == 0), "s", ["att", "outl"])
    return out.select("variable", *[r6(F.col(c)).alias(c) for c in ("in_sample", "outside", "all")])


@query(f"""SELECT count(*) FILTER (w > 200000)::BIGINT AS n_cut, count(*) FILTER (w <= 200000)::BIGINT AS n_whole, count(*) FILTER (w > 200000 AND att <> att_b)::BIGINT AS wrong_cut, count(*) FILTER (w <= 200000 AND att <> att_b)::BIGINT AS wrong_whole,
 round(quantile_cont(CASE WHEN w > 200000 THEN w - 200000 END, 0.25), 6) AS held_p25, round(quantile_cont(CASE WHEN w > 200000 THEN w - 200000 END, 0.5), 6) AS held_p50, round(quantile_cont(CASE WHEN w > 200000 THEN w - 200000 END, 0.75), 6) AS held_p75 FROM (SELECT *, o_totalprice AS w FROM {PANEL_SQL})""")
def truncation_diagnostic(spark, sf_dir):
    p = panel(spark, sf_dir).select(F.col("att").alias("a"), F.col("att_b").alias("b"), F.col("o_totalprice").alias("w"))
    out = agreement.truncation_diagnostic(p, "w", 200000)
    return out.select("n_cut", "n_whole", "wrong_cut", "wrong_whole", *[r6(F.col(c)).alias(c) for c in ("held_p25", "held_p50", "held_p75")])


@query(f"SELECT instrument, round(po, 6) AS agreement, n FROM (SELECT 'model' AS instrument, avg((att = att_b)::INT::DOUBLE) AS po, count(*)::BIGINT AS n FROM {PANEL_SQL} UNION ALL SELECT 'price', avg(((o_totalprice > 150000)::INT = att_b)::INT::DOUBLE), count(*)::BIGINT FROM {PANEL_SQL})")
def horse_race(spark, sf_dir):
    p = panel(spark, sf_dir).withColumns({"model": F.col("att"), "price": (F.col("o_totalprice") > 150000).cast("int")})
    cells = p.unpivot(["o_orderkey", "att_b"], ["model", "price"], "instrument", "code").withColumns({"variable": F.lit("att"), "human": F.col("att_b")})
    return agreement.horse_race(cells).select("instrument", r6(F.col("agreement")).alias("agreement"), "n")


@query(f"SELECT year(d)::INT AS year, round(avg((att = att_b)::INT::DOUBLE), 6) AS agreement FROM {PANEL_SQL} WHERE att_b = 1 GROUP BY 1")
def restricted_agreement(spark, sf_dir):
    p = panel(spark, sf_dir).where("att_b = 1").select(F.year("d").alias("year"), F.col("att").alias("a"), F.col("att_b").alias("b"))
    return agreement.pooled(p, ["year"]).select("year", r6(F.col("agreement")).alias("agreement"))


@query(f"SELECT round(s, 6) AS sensitivity, round(p, 6) AS specificity, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (q - (1 - p)) / (s + p - 1))), 6) AS corrected FROM (SELECT avg(CASE WHEN att_b = 1 THEN att::DOUBLE END) AS s, avg(CASE WHEN att_b = 0 THEN 1 - att::DOUBLE END) AS p, avg(att::DOUBLE) AS q FROM {PANEL_SQL})")
def estimated_correction(spark, sf_dir):
    a, b = F.col("att").cast("double"), F.col("att_b")
    e = panel(spark, sf_dir).agg(F.avg(F.when(b == 1, a)).alias("s"), F.avg(F.when(b == 0, 1 - a)).alias("p"), F.avg(a).alias("q"))
    return e.select(r6(F.col("s")).alias("sensitivity"), r6(F.col("p")).alias("specificity"), r6(measures.corrected(F.col("q"), F.col("s"), F.col("p"))).alias("corrected"))

"""Small-sample inference, group by group: checked against identities and closed forms in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement, inference, ordered
from .catalogue import panel, query, r6, table

MONTHS_SQL = "(SELECT date_trunc('month', o_orderdate)::DATE AS t, avg(o_totalprice) AS p, count(*)::DOUBLE AS n, avg((o_orderstatus = 'F')::INT::DOUBLE) AS f FROM orders GROUP BY 1)"


def months(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("t")).agg(F.avg("o_totalprice").alias("p"), F.count("*").cast("double").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"))


def stacked(spark, sf_dir):
    return inference.stack(months(spark, sf_dir), "t", [("p", "n"), ("p", "f"), ("n", "f")])


@query(f"SELECT spec, round(r, 6) AS correlation, n_obs, floor(4 * pow(n_obs / 100.0::DOUBLE, 2.0::DOUBLE / 9))::INT AS lags FROM (SELECT 'p~n' AS spec, corr(p, n) AS r, count(*)::INT AS n_obs FROM {MONTHS_SQL} UNION ALL SELECT 'p~f', corr(p, f), count(*)::INT FROM {MONTHS_SQL} UNION ALL SELECT 'n~f', corr(n, f), count(*)::INT FROM {MONTHS_SQL})")
def corr_point(spark, sf_dir):
    return inference.correlations(stacked(spark, sf_dir), ["spec"]).select("spec", r6(F.col("correlation")).alias("correlation"), "n_obs", "lags")


@query()
def corr_hac(spark, sf_dir):
    return inference.correlations(stacked(spark, sf_dir), ["spec"])


@query()
def block_bootstrap(spark, sf_dir):
    return inference.correlation_rows(stacked(spark, sf_dir), ["spec"], {"p~n": 1, "p~f": -1, "n~f": 1})


@query()
def alternative_inference(spark, sf_dir):
    return inference.alternative_inference(stacked(spark, sf_dir), ["spec"])


@query()
def kappa_bootstrap(spark, sf_dir):
    p = panel(spark, sf_dir).withColumnsRenamed({"att": "inflation_attention_a", "att_b": "inflation_attention_b", "outl": "inflation_outlook_a", "outl_b": "inflation_outlook_b"})
    pairs = agreement.long_pairs(p, ["o_orderkey"], ["inflation_attention", "inflation_outlook"], ("_a", "_b"))
    return agreement.with_intervals(agreement.agreement_table(pairs), pairs)


@query()
def driscoll_kraay(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("unit"), F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("t")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("x"))
    return inference.panel_regression(o.withColumn("g", F.lit(1)), ["g"], 4)


@query()
def local_projection(spark, sf_dir):
    return inference.local_projections(months(spark, sf_dir), "t", "f", "p", 8, interact="n")


@query()
def era_difference(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t")
    return inference.break_sensitivity(m, F.year("t"), [1997, 1998, 1999, 2000])


@query()
def williams(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f")
    return inference.dependent_difference(m, ["g"])


@query()
def partial_corr(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f")
    a = inference.partial(m, ["g"], True).withColumn("form", F.lit("full"))
    return a.unionByName(inference.partial(m, ["g"], False).withColumn("form", F.lit("semi")))


@query()
def factor_assessment(spark, sf_dir):
    return inference.factor_assessment(stacked(spark, sf_dir), ["spec"])


@query()
def level_control(spark, sf_dir):
    return inference.level_control(inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f"), ["g"])


@query()
def bandwidth_sensitivity(spark, sf_dir):
    return inference.bandwidth_sensitivity(inference.pairs(months(spark, sf_dir), "p", "n", "t"), [0, 1, 2, 3, 4, 6, 8])


@query(f"SELECT count(*) FILTER (s > 0)::BIGINT AS positive, count(*)::BIGINT AS n FROM (SELECT corr(p, n) AS s FROM {MONTHS_SQL} UNION ALL SELECT corr(p, f) FROM {MONTHS_SQL} UNION ALL SELECT corr(n, f) FROM {MONTHS_SQL})")
def sign_counts(spark, sf_dir):
    c = inference.correlations(stacked(spark, sf_dir), ["spec"]).withColumn("up", F.col("correlation") > 0)
    return inference.sign_test(c, "up").select("positive", "n")


@query()
def construct_check(spark, sf_dir):
    w = ordered.over("t")
    m = months(spark, sf_dir).withColumns({"dp": ordered.difference(F.col("p"), w), "fp": ordered.lead_difference(F.col("p"), 1, w)})
    return inference.correlations(inference.stack(m, "t", [("n", "p"), ("n", "dp"), ("n", "fp")]), ["spec"])


@query()
def holm_count(spark, sf_dir):
    return inference.holm_count(inference.correlations(stacked(spark, sf_dir), ["spec"]), "p_value")

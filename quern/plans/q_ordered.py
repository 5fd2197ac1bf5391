"""Ordered operators over period frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered, relational
from .catalogue import panel, query, r6, table

_MONTHS = "(SELECT date_trunc('month', o_orderdate)::DATE AS m, avg(o_totalprice) AS x FROM orders GROUP BY 1)"


def _months(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("m")).agg(F.avg("o_totalprice").alias("x"))


@query(f"SELECT m, round(lead(x, 3) OVER (ORDER BY m) - x, 6) AS ahead FROM {_MONTHS}")
def lead_diff(spark, sf_dir):
    return _months(spark, sf_dir).select("m", r6(ordered.lead_difference(F.col("x"), 3, ordered.over("m"))).alias("ahead"))


@query(f"SELECT m, round(x - lag(x) OVER (ORDER BY m), 6) AS change FROM {_MONTHS}")
def first_diff(spark, sf_dir):
    return _months(spark, sf_dir).select("m", r6(ordered.difference(F.col("x"), ordered.over("m"))).alias("change"))


@query(f"SELECT m, round(lag(x, 2) OVER (ORDER BY m) - lag(x, 3) OVER (ORDER BY m), 6) AS change, round(lag(x, 2) OVER (ORDER BY m), 6) AS lagged FROM {_MONTHS}")
def lagged_diff(spark, sf_dir):
    w = ordered.over("m")
    return _months(spark, sf_dir).select("m", r6(ordered.lagged_difference(F.col("x"), w, 2)).alias("change"), r6(F.lag("x", 2).over(w)).alias("lagged"))


@query(f"SELECT m, round(CASE WHEN v IS NOT NULL THEN sum(v) OVER (ORDER BY m) END, 4) AS total FROM (SELECT m, CASE WHEN month(m) <> 4 THEN x END AS v FROM {_MONTHS})")
def cumsum_null_safe(spark, sf_dir):
    v = _months(spark, sf_dir).withColumn("v", F.when(F.month("m") != 4, F.col("x")))
    return v.select("m", F.round(ordered.running_total(F.col("v"), ordered.over("m")), 4).alias("total"))


#: Gaps come from the data: of the days of all orders, those on which the largest price enters another band, and the last.
_BAND = 10000
_CHANGES = f"(SELECT d, v FROM (SELECT d, v, lag(v) OVER (ORDER BY d) AS old, row_number() OVER (ORDER BY d DESC) AS back FROM (SELECT o_orderdate::DATE AS d, floor(max(o_totalprice) / {_BAND}) * {_BAND} AS v FROM orders GROUP BY 1)) WHERE old IS NULL OR v <> old OR back = 1)"


def _changes(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.floor(F.max("o_totalprice") / _BAND) * F.lit(float(_BAND))).alias("v"))
    w = ordered.over("d")
    days = days.withColumns({"old": F.lag("v").over(w), "next": F.lead("d").over(w)})
    return days.where("old is null or v <> old or next is null").select("d", "v")


_DAILY = f"(SELECT g AS d, last_value(v IGNORE NULLS) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS g FROM {_CHANGES}) LEFT JOIN {_CHANGES} ON d = g)"


@query(f"SELECT d, v FROM {_DAILY}")
def ffill_daily(spark, sf_dir):
    return ordered.daily(_changes(spark, sf_dir), "d", "v").select("d", "v")


@query(f"SELECT date_trunc('quarter', d)::DATE AS period, round(arg_max(v, d), 6) AS v_eop, round(avg(v), 6) AS v_avg FROM {_DAILY} GROUP BY 1")
def eop_avg_quarter(spark, sf_dir):
    out = ordered.end_and_mean(_changes(spark, sf_dir), "d", "v")
    return out.select("period", r6(F.col("v_eop")).alias("v_eop"), r6(F.col("v_avg")).alias("v_avg"))


@query(f"SELECT round(sum((x - mu) * prev) / sum((x - mu) * (x - mu)), 6) AS acf FROM (SELECT x, mu, lag(x - mu) OVER (ORDER BY m) AS prev FROM (SELECT *, avg(x) OVER () AS mu FROM {_MONTHS}))")
def acf_lag1(spark, sf_dir):
    return ordered.autocorrelation(_months(spark, sf_dir), "m", "x").select(r6(F.col("acf")).alias("acf"))


@query(f"SELECT date_trunc('quarter', m)::DATE AS period, round(avg(x), 6) AS x, count(x)::BIGINT AS n_months FROM {_MONTHS} GROUP BY 1")
def monthly_to_quarterly(spark, sf_dir):
    return ordered.to_quarters(_months(spark, sf_dir), "m", "x", "n_months").select("period", r6(F.col("x")).alias("x"), "n_months")


_EVENTS = "(SELECT date_trunc('quarter', d)::DATE AS period, sum(CASE WHEN d >= DATE '1996-01-01' THEN v END) AS qe, sum(v) AS target FROM (SELECT o_orderdate::DATE AS d, o_totalprice / 1000 AS v FROM orders) GROUP BY 1)"


@query(f"SELECT period, round(target, 6) AS target, round(qe, 6) AS qe, round(sum(target) OVER (ORDER BY period), 6) AS target_cumulative, round(CASE WHEN qe IS NOT NULL THEN sum(qe) OVER (ORDER BY period) END, 6) AS qe_cumulative FROM {_EVENTS}")
def event_to_quarter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), (F.col("o_totalprice") / 1000).alias("target"))
    e = o.withColumn("qe", F.when(F.col("d") >= "1996-01-01", F.col("target")))
    out = ordered.events_by_quarter(e, "d", ["target", "qe"])
    return out.select("period", *[r6(F.col(c)).alias(c) for c in ("target", "qe", "target_cumulative", "qe_cumulative")])


_P = "(SELECT c_mktsegment AS k, c_custkey AS i, (c_custkey % 97) / 500.0::DOUBLE AS p FROM customer)"


@query(f"SELECT k, i, p, round(max(s) OVER (PARTITION BY k ORDER BY p, i ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY k) - row_number() OVER (PARTITION BY k ORDER BY p, i) + 1) * p) AS s FROM {_P})")
def holm_adjust(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("k"), (F.col("c_custkey") % 97 / F.lit(500.0)).alias("p"))
    return ordered.holm(c, "p", ["k"]).select("k", "i", "p", F.round("p_holm", 9).alias("p_holm"))


@query("SELECT o_custkey, count(*)::BIGINT AS n, floor(4 * pow(count(*) / 100.0::DOUBLE, 2.0::DOUBLE / 9))::BIGINT AS lags, (CASE WHEN round(cbrt(count(*)))^3 = count(*) THEN round(cbrt(count(*))) ELSE ceil(cbrt(count(*))) END)::BIGINT AS block FROM orders GROUP BY 1")
def nw_bandwidth(spark, sf_dir):
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return out.select("o_custkey", "n", ordered.bandwidth(F.col("n")).alias("lags"), ordered.block_length(F.col("n")).alias("block"))


@query("SELECT o_custkey % 20 AS k, o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / stddev_samp(o_totalprice) OVER w, 6) AS z FROM orders WINDOW w AS (PARTITION BY o_custkey % 20)")
def standardise(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("k"), "o_orderkey", "o_totalprice")
    return o.select("k", "o_orderkey", r6(ordered.standardised(F.col("o_totalprice"), ["k"])).alias("z"))


@query("SELECT (date_trunc('quarter', o_orderdate) - INTERVAL 6 MONTH)::DATE AS period, round(sqrt(avg(o_totalprice)), 6) AS disp, count(o_totalprice)::BIGINT AS disp_n_rounds FROM orders GROUP BY 1")
def survey_rounds(spark, sf_dir):
    out = ordered.survey_rounds(table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate")), "d", "o_totalprice", 2, "disp")
    return out.select("period", r6(F.col("disp")).alias("disp"), "disp_n_rounds")


@query(f"SELECT arg_max(m, x) AS peak, round(max(x), 6) AS peak_value, round(quantile_cont(x, 0.5), 6) AS median, max(x) >= 2 * quantile_cont(x, 0.5) AS stands_out FROM {_MONTHS}")
def peak_check(spark, sf_dir):
    out = ordered.peak_check(_months(spark, sf_dir), "m", "x")
    return out.select("peak", r6(F.col("peak_value")).alias("peak_value"), r6(F.col("median")).alias("median"), "stands_out")


@query("SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS value, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def irregular_daily_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(r6(F.avg("value")).alias("value"), F.count("*").alias("n"))


@query(f"SELECT a.m, round(a.x, 6) AS price, round(b.x, 6) AS quantity, round(lead(a.x) OVER (ORDER BY a.m) - a.x, 6) AS price_change FROM {_MONTHS} a JOIN (SELECT date_trunc('month', l_shipdate)::DATE AS m, avg(l_quantity) AS x FROM lineitem GROUP BY 1) b USING (m)")
def merged_series(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.trunc(F.to_date("l_shipdate"), "month")).alias("m")).agg(F.avg("l_quantity").alias("q"))
    j = relational.join_one_to_one(_months(spark, sf_dir), b, ["m"], "inner")
    return j.select("m", r6(F.col("x")).alias("price"), r6(F.col("q")).alias("quantity"), r6(ordered.lead_difference(F.col("x"), 1, ordered.over("m"))).alias("price_change"))

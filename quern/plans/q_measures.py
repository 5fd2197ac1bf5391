"""Measures of coded texts by calendar period."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures, ordered
from .catalogue import PANEL_SQL, panel, query, r6, table

TOPIC, OUT = {"a": "att"}, {"a": "outl"}
RATES = (0.9, 0.8)
_LABEL = {"month": "strftime(d, '%Y-%m')", "quarter": "year(d) || 'Q' || quarter(d)", "year": "year(d)::VARCHAR"}


def _sql(freq: str) -> str:
    return f"""SELECT {_LABEL[freq]} AS period, count(*)::BIGINT AS n_speeches, count(DISTINCT o_custkey)::BIGINT AS n_speakers,
 round(avg(ln(o_totalprice)), 6) AS mean_log_words, round(avg(att::DOUBLE), 6) AS att_a, sum(att)::BIGINT AS vol_a,
 round(sum(att * outl)::DOUBLE / nullif(sum(att), 0), 6) AS out_a, round(stddev_samp(CASE WHEN att = 1 THEN outl::DOUBLE END), 6) AS disp_a,
 round(2 * least(count(*) FILTER (att = 1 AND outl = 1), count(*) FILTER (att = 1 AND outl = -1))::DOUBLE / nullif(count(*) FILTER (att = 1 AND outl <> 0), 0), 6) AS polar_a,
 round(avg(CASE WHEN att = 1 THEN (outl = 1)::INT::DOUBLE END), 6) AS share_up_a, round(avg(CASE WHEN att = 1 THEN (outl = -1)::INT::DOUBLE END), 6) AS share_down_a,
 round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (avg(att::DOUBLE) - 0.2::DOUBLE) / 0.7::DOUBLE)), 6) AS att_a_corr, count(*) < 3 AS sparse
 FROM {PANEL_SQL} GROUP BY 1"""


def _measures(spark, sf_dir, freq):
    out = measures.aggregate(panel(spark, sf_dir), freq, "d", "o_custkey", "o_totalprice", topics=TOPIC, outlooks=OUT, rates={"a": RATES})
    return out.select("period", "n_speeches", "n_speakers", r6(F.col("mean_log_words")).alias("mean_log_words"), "vol_a", "sparse", *[r6(F.col(c)).alias(c) for c in ("att_a", "out_a", "disp_a", "polar_a", "share_up_a", "share_down_a", "att_a_corr")])


@query(_sql("month"))
def measures_month(spark, sf_dir):
    return _measures(spark, sf_dir, "month")


@query(_sql("quarter"))
def measures_quarter(spark, sf_dir):
    return _measures(spark, sf_dir, "quarter")


@query(_sql("year"))
def measures_year(spark, sf_dir):
    return _measures(spark, sf_dir, "year")


@query(f"""SELECT freq, period, count(*)::BIGINT AS n, round(avg(att::DOUBLE), 6) AS att, round(sum(att * outl)::DOUBLE / nullif(sum(att), 0), 6) AS "out"
 FROM (SELECT 'month' AS freq, {_LABEL['month']} AS period, att, outl FROM {PANEL_SQL} UNION ALL SELECT 'quarter', {_LABEL['quarter']}, att, outl FROM {PANEL_SQL} UNION ALL SELECT 'year', {_LABEL['year']}, att, outl FROM {PANEL_SQL}) GROUP BY 1, 2""")
def measures_all_frequencies(spark, sf_dir):
    out = measures.all_frequencies(panel(spark, sf_dir), "d", "att", "outl")
    return out.select("freq", "period", "n", r6(F.col("att")).alias("att"), r6(F.col("out")).alias("out"))


@query(f"""SELECT k AS corner_case, round(CASE WHEN s + p - 1 > 1e-6 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (a - (1 - p)) / (s + p - 1))) ELSE a END, 6) AS corrected
 FROM (SELECT avg(att::DOUBLE) AS a FROM {PANEL_SQL}), (VALUES ('good', 0.9::DOUBLE, 0.8::DOUBLE), ('useless', 0.5::DOUBLE, 0.5::DOUBLE), ('clipped', 0.55::DOUBLE, 0.99::DOUBLE)) v(k, s, p)""")
def corrected_share(spark, sf_dir):
    cases = spark.createDataFrame([("good", 0.9, 0.8), ("useless", 0.5, 0.5), ("clipped", 0.55, 0.99)], "corner_case string, s double, p double")
    a = panel(spark, sf_dir).agg(measures.share(F.col("att")).alias("a"))
    return a.crossJoin(F.broadcast(cases)).select("corner_case", r6(measures.corrected(F.col("a"), F.col("s"), F.col("p"))).alias("corrected"))


@query(f"""SELECT round(min(c), 6) AS low, round(max(c), 6) AS high FROM (SELECT CASE WHEN s + p - 1 > 1e-6 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (a - (1 - p)) / (s + p - 1))) END AS c
 FROM (SELECT avg(att::DOUBLE) AS a FROM {PANEL_SQL}), (VALUES (0.7::DOUBLE), (0.95::DOUBLE)) x(s), (VALUES (0.25::DOUBLE), (0.9::DOUBLE)) y(p))""")
def corner_bounds(spark, sf_dir):
    a = panel(spark, sf_dir).agg(measures.share(F.col("att")).alias("a"))
    b = measures.corner_bounds(F.col("a"), (F.lit(0.7), F.lit(0.95)), (F.lit(0.25), F.lit(0.9)))
    return a.select(r6(b["low"]).alias("low"), r6(b["high"]).alias("high"))


@query(f"""SELECT round(sum(att * outl)::DOUBLE / nullif(sum(att), 0), 6) AS weighted, round(avg(CASE WHEN att = 1 THEN outl::DOUBLE END), 6) AS conditional FROM {PANEL_SQL}""")
def weighted_equals_conditional(spark, sf_dir):
    p = panel(spark, sf_dir)
    a, o = F.col("att"), F.col("outl")
    return p.agg(r6(measures.outlook(a, o)).alias("weighted"), r6(F.avg(F.when(a == 1, o.cast("double")))).alias("conditional"))


@query(f"""WITH m AS (SELECT {_LABEL['month']} AS period, avg(att::DOUBLE) AS att_a, sum(att * outl)::DOUBLE / nullif(sum(att), 0) AS out_a FROM {PANEL_SQL} GROUP BY 1)
 SELECT variable, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (SELECT 'att_a' AS variable, att_a AS v FROM m UNION ALL SELECT 'out_a', out_a FROM m) GROUP BY 1""")
def summary_table(spark, sf_dir):
    m = measures.aggregate(panel(spark, sf_dir), "month", "d", None, None, topics=TOPIC, outlooks=OUT)
    return measures.summary(m, ["att_a", "out_a"]).select("variable", *[r6(F.col(c)).alias(c) for c in ("mean", "sd", "min", "max")])


@query(f"""WITH y AS (SELECT year(d)::INT AS year, count(*)::BIGINT AS n, avg(o_totalprice) AS m FROM {PANEL_SQL} GROUP BY 1)
 SELECT year, n, round(m, 6) AS mean_words, round(1 - m / max(m) OVER (), 6) AS decline, year = first_value(year) OVER (ORDER BY m, year) AS is_trough FROM y""")
def length_trend(spark, sf_dir):
    out = measures.length_trend(panel(spark, sf_dir), "d", "o_totalprice")
    return out.select("year", "n", r6(F.col("mean_words")).alias("mean_words"), r6(F.col("decline")).alias("decline"), "is_trough")


@query(f"""WITH a AS (SELECT {_LABEL['month']} AS period, avg(att::DOUBLE) AS att_a, sum(att * outl)::DOUBLE / nullif(sum(att), 0) AS out_a FROM {PANEL_SQL} GROUP BY 1),
 b AS (SELECT {_LABEL['month']} AS period, avg(att::DOUBLE) AS att_a, sum(att * outl)::DOUBLE / nullif(sum(att), 0) AS out_a FROM {PANEL_SQL} WHERE o_custkey % 3 <> 0 GROUP BY 1)
 SELECT 'att_a' AS variable, round(corr(a.att_a, b.att_a), 6) AS r, count(*)::BIGINT AS n FROM a JOIN b USING (period) UNION ALL SELECT 'out_a', round(corr(a.out_a, b.out_a), 6), count(*) FILTER (a.out_a IS NOT NULL AND b.out_a IS NOT NULL)::BIGINT FROM a JOIN b USING (period)""")
def language_robustness(spark, sf_dir):
    p = panel(spark, sf_dir)
    full, part = (measures.aggregate(x, "month", "d", None, None, topics=TOPIC, outlooks=OUT) for x in (p, p.where("o_custkey % 3 <> 0")))
    return measures.robustness(full, part, ["att_a", "out_a"]).select("variable", r6(F.col("r")).alias("r"), "n")


@query(f"""WITH p AS (SELECT * FROM {PANEL_SQL} WHERE month(d) NOT IN (5, 6)),
 m AS (SELECT date_trunc('month', d)::DATE AS s, count(*)::BIGINT AS n, sum(att)::BIGINT AS v, avg(att::DOUBLE) AS a FROM p GROUP BY 1),
 c AS (SELECT unnest(generate_series(min(s), max(s), INTERVAL 1 MONTH))::DATE AS s FROM m)
 SELECT strftime(c.s, '%Y-%m') AS period, coalesce(n, 0)::BIGINT AS n_speeches, coalesce(v, 0)::BIGINT AS vol_a, round(a, 6) AS att_a, coalesce(n, 0) < 3 AS sparse FROM c LEFT JOIN m USING (s)""")
def calendar_gapfill(spark, sf_dir):
    m = measures.aggregate(panel(spark, sf_dir).where("month(d) not in (5, 6)"), "month", "d", None, None, topics=TOPIC, outlooks={})
    return measures.reindex_calendar(m, "month").select("period", "n_speeches", "vol_a", r6(F.col("att_a")).alias("att_a"), "sparse")


@query(f"""SELECT {_LABEL['quarter']} AS period, round(avg(att_b::DOUBLE), 6) AS att_b, round(sum(att_b * outl_b)::DOUBLE / nullif(sum(att_b), 0), 6) AS out_b FROM {PANEL_SQL} GROUP BY 1""")
def instrument_shares(spark, sf_dir):
    out = measures.instrument_shares(panel(spark, sf_dir), "quarter", "d", "", {"b": "att_b"}, {"b": "outl_b"})
    return out.select("period", r6(F.col("att_b")).alias("att_b"), r6(F.col("out_b")).alias("out_b"))


@query(f"""SELECT o_custkey % 10 AS grp, count(*)::BIGINT AS n, round(avg(att::DOUBLE), 6) AS raw, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (avg(att::DOUBLE) - 0.2::DOUBLE) / 0.7::DOUBLE)), 6) AS corrected FROM {PANEL_SQL} GROUP BY 1""")
def corrected_series(spark, sf_dir):
    out = measures.correct_series(panel(spark, sf_dir).withColumn("grp", F.col("o_custkey") % 10), "att", RATES, ["grp"])
    return out.select("grp", "n", r6(F.col("raw")).alias("raw"), r6(F.col("corrected")).alias("corrected"))


@query("""SELECT round(tp / (tp + fp), 6) AS ppv, round(q * (tp / (tp + fp)) / p, 6) AS sensitivity, round((1 - q) * (tn / (tn + fn)) / (1 - p), 6) AS specificity, round(p, 6) AS prevalence
 FROM (SELECT *, q * (tp / (tp + fp)) + (1 - q) * (1 - tn / (tn + fn)) AS p FROM (SELECT 0.4::DOUBLE AS q, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS fp, count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS tn, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS fn FROM labels))""")
def ppv_npv_bayes(spark, sf_dir):
    n = table(spark, sf_dir, "labels").agg(*[F.count_if((F.col("quality") == a) & (F.col("toxic") == b)).cast("double").alias(k) for k, a, b in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))])
    ppv, npv = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tn") / (F.col("tn") + F.col("fn"))
    r = measures.recovered_rates(ppv, npv, F.lit(0.4))
    return n.select(r6(ppv).alias("ppv"), *[r6(c).alias(k) for k, c in r.items()])


@query(f"""SELECT year(d) || 'Q' || quarter(d) AS label, date_trunc('quarter', d)::DATE AS period_start, (date_trunc('quarter', d) + INTERVAL 6 MONTH)::DATE AS later, count(*)::BIGINT AS n FROM {PANEL_SQL} GROUP BY 1, 2, 3""")
def period_arithmetic(spark, sf_dir):
    p = panel(spark, sf_dir)
    start = ordered.quarter_start(F.col("d"))
    return p.groupBy(ordered.quarter_label(F.col("d")).alias("label"), start.alias("period_start"), F.add_months(start, 6).alias("later")).agg(F.count("*").alias("n"))

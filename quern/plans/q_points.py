"""Estimates and robust standard errors of series, each with its SQL: what needs no quantile of a distribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference, ordered
from .catalogue import query, r6, table
from .q_kernels import MONTHS_SQL, months, stacked

_BANDWIDTH = "floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9))::INT"
_THREE = f"SELECT 'p~n' AS spec, t, p AS x, n AS y FROM {MONTHS_SQL} UNION ALL SELECT 'p~f', t, p, f FROM {MONTHS_SQL} UNION ALL SELECT 'n~f', t, n, f FROM {MONTHS_SQL}"


def _hac(long: str, lags: str = _BANDWIDTH, controls: tuple[str, ...] = (), scaled: bool = True, key: str = "spec") -> str:
    """Slope of y on x and its Bartlett standard error by ``key``, from rows key, t, x, y and controls.

    Series are centred and, if ``scaled``, standardised; then one control after
    another is taken out of all that follow, which leaves the same slope and errors.
    """
    names = ["y", "x", *controls]
    centre = ", ".join(f"({c} - avg({c}) OVER w){f' / stddev_samp({c}) OVER w' if scaled else ''} AS {c}" for c in names)
    steps = [f"z0 AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY t) AS i, {centre} FROM l WINDOW w AS (PARTITION BY {key}))"]
    for k, c in enumerate(reversed(controls)):
        left = names[: len(names) - 1 - k]
        out = ", ".join(f"{v} - sum({v} * {c}) OVER w / sum({c} * {c}) OVER w * {c} AS {v}" for v in left)
        steps.append(f"z{k + 1} AS (SELECT {key}, i, {out} FROM z{k} WINDOW w AS (PARTITION BY {key}))")
    z = f"z{len(controls)}"
    return f"""(WITH l AS ({long}), {", ".join(steps)},
 b AS (SELECT *, {lags} AS lags FROM (SELECT {key}, count(*) AS n, sum(x * y) / sum(x * x) AS slope, sum(x * x) AS sxx FROM {z} GROUP BY 1)),
 s AS (SELECT {key}, i, x * (y - slope * x) / sxx AS s FROM {z} JOIN b USING ({key})),
 g AS (SELECT {key}, sum(a.s * c.s * (1 - abs(a.i - c.i) / (lags + 1.0::DOUBLE))) AS v FROM s a JOIN s c USING ({key}) JOIN b USING ({key}) WHERE abs(a.i - c.i) <= lags GROUP BY 1)
 SELECT {key}, slope, sqrt(v * n / (n - {2 + len(controls)})) AS se, n::INT AS n_obs, lags FROM b JOIN g USING ({key}))"""


def _rounded(df, keep, *values):
    return df.select(*keep, *[r6(F.col(c)).alias(c) for c in values])


@query(f"SELECT spec, round(slope, 6) AS correlation, round(se, 6) AS standard_error, round(slope / se, 6) AS t_statistic, n_obs, lags FROM {_hac(_THREE)}")
def hac_points(spark, sf_dir):
    return _rounded(inference.correlations(stacked(spark, sf_dir), ["spec"]), ["spec", "n_obs", "lags"], "correlation", "standard_error", "t_statistic")


@query(f"SELECT spec, round(slope, 6) AS correlation, expected_sign::INT AS expected_sign, sign(slope) = expected_sign AS as_expected, reliability FROM {_hac(_THREE)} JOIN (VALUES ('p~n', 1, 0.8::DOUBLE), ('p~f', -1, NULL), ('n~f', 1, 0.65::DOUBLE)) v(spec, expected_sign, reliability) USING (spec)")
def expected_signs(spark, sf_dir):
    rows = inference.correlation_rows(stacked(spark, sf_dir), ["spec"], {"p~n": 1, "p~f": -1, "n~f": 1})
    stored = spark.createDataFrame([("p~n", 0.8), ("n~f", 0.65), ("f~f", 0.9)], "spec string, reliability double")
    return inference.with_reliability(rows, stored, ["spec"]).select("spec", r6(F.col("correlation")).alias("correlation"), "expected_sign", "as_expected", "reliability")


_CHANGES = f"(SELECT *, p - lag(p) OVER (ORDER BY t) AS dp, lead(p) OVER (ORDER BY t) - p AS fp FROM {MONTHS_SQL})"
_CONSTRUCTS = f"SELECT 'n~p' AS spec, t, n AS x, p AS y FROM {_CHANGES} UNION ALL SELECT 'n~dp', t, n, dp FROM {_CHANGES} WHERE dp IS NOT NULL UNION ALL SELECT 'n~fp', t, n, fp FROM {_CHANGES} WHERE fp IS NOT NULL"


def _changes(spark, sf_dir):
    w = ordered.over("t")
    return months(spark, sf_dir).withColumns({"dp": ordered.difference(F.col("p"), w), "fp": ordered.lead_difference(F.col("p"), 1, w)})


@query(f"SELECT spec, round(slope, 6) AS correlation, round(se, 6) AS standard_error, n_obs FROM {_hac(_CONSTRUCTS)}")
def construct_points(spark, sf_dir):
    m = inference.stack(_changes(spark, sf_dir), "t", [("n", "p"), ("n", "dp"), ("n", "fp")])
    return _rounded(inference.correlations(m, ["spec"]), ["spec", "n_obs"], "correlation", "standard_error")


@query(f"""SELECT a.spec, round(a.slope, 6) AS correlation, round(a.se, 6) AS standard_error, a.n_obs, round(b.slope, 6) AS baseline, round(a.slope - b.slope, 6) AS difference, sign(a.slope) = sign(b.slope) AS same_sign
 FROM {_hac(_CONSTRUCTS)} a, {_hac(_CONSTRUCTS)} b WHERE b.spec = 'n~p'""")
def alternative_specs(spark, sf_dir):
    out = inference.alternative_specs(_changes(spark, sf_dir), "t", "n", "p", ["dp", "fp"])
    return _rounded(out, ["spec", "n_obs", "same_sign"], "correlation", "standard_error", "baseline", "difference")


def _out(c: str) -> str:
    return f"{c} - avg({c}) OVER () - covar_samp({c}, f) OVER () / var_samp(f) OVER () * (f - avg(f) OVER ())"


_FORMS = f"SELECT 'full' AS spec, t, {_out('p')} AS x, {_out('n')} AS y FROM {MONTHS_SQL} UNION ALL SELECT 'semi', t, {_out('p')}, n FROM {MONTHS_SQL}"


@query(f"SELECT spec AS form, round(slope, 6) AS correlation, round(se, 6) AS standard_error, n_obs FROM {_hac(_FORMS)}")
def partial_points(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f")
    both = [inference.partial(m, ["g"], full).withColumn("form", F.lit(form)) for form, full in (("full", True), ("semi", False))]
    return _rounded(both[0].unionByName(both[1]), ["form", "n_obs"], "correlation", "standard_error")


_GROUP = f"SELECT 1 AS spec, t, p AS x, n AS y, f AS z FROM {MONTHS_SQL}"


@query(f"SELECT spec AS g, round(slope, 6) AS slope, round(se, 6) AS standard_error, round((xy * xy + yz * yz - 2 * xy * yz * xz) / (1 - xz * xz), 6) AS r_squared FROM {_hac(_GROUP, controls=('z',))}, (SELECT corr(p, n) AS xy, corr(n, f) AS yz, corr(p, f) AS xz FROM {MONTHS_SQL})")
def level_points(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f")
    return _rounded(inference.level_control(m, ["g"]), ["g"], "slope", "standard_error", "r_squared")


_LAGS = (0, 1, 2, 3, 4, 6, 8)
_BY_LAGS = f"SELECT k AS spec, t, p AS x, n AS y FROM {MONTHS_SQL}, (VALUES {', '.join(f'({k})' for k in _LAGS)}) v(k)"


@query(f"SELECT spec AS bandwidth, round(slope, 6) AS correlation, round(se, 6) AS standard_error FROM {_hac(_BY_LAGS, lags='spec')}")
def bandwidth_points(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t")
    return _rounded(inference.bandwidth_sensitivity(m, list(_LAGS)), ["bandwidth"], "correlation", "standard_error")


@query(f"""WITH r AS (SELECT corr(p, n) AS xy, corr(p, f) AS xz, corr(n, f) AS yz, count(*) AS n FROM {MONTHS_SQL})
 SELECT round(xy, 6) AS r_xy, round(xz, 6) AS r_xz, round(slope, 6) AS difference, round(se, 6) AS hac_se,
 round((xy - xz) * sqrt((n - 1) * (1 + yz) / (2 * (1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz) * (n - 1) / (n - 3) + pow((xy + xz) / 2, 2) * pow(1 - yz, 3))), 6) AS williams_t
 FROM r, {_hac(f"SELECT 1 AS spec, t, (p - avg(p) OVER ()) / stddev_samp(p) OVER () AS x, (n - avg(n) OVER ()) / stddev_samp(n) OVER () - (f - avg(f) OVER ()) / stddev_samp(f) OVER () AS y FROM {MONTHS_SQL}", scaled=False)}""")
def williams_points(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t", {"g": F.lit(1)}, z="f")
    return _rounded(inference.dependent_difference(m, ["g"]), [], "r_xy", "r_xz", "difference", "hac_se", "williams_t")


@query(f"SELECT spec, round(corr(x, y), 6) AS correlation, round(regr_slope(y, x), 6) AS slope, round(max(ar), 6) AS ar1, count(*)::INT AS n_obs FROM (SELECT *, sum(d * e) OVER (PARTITION BY spec) / sum(d * d) OVER (PARTITION BY spec) AS ar FROM (SELECT *, lead(d) OVER (PARTITION BY spec ORDER BY t) AS e FROM (SELECT *, y - avg(y) OVER (PARTITION BY spec) AS d FROM ({_THREE})))) GROUP BY 1")
def factor_points(spark, sf_dir):
    return _rounded(inference.factor_assessment(stacked(spark, sf_dir), ["spec"]), ["spec", "n_obs"], "correlation", "slope", "ar1")


_CENTRED = f"z AS (SELECT spec, row_number() OVER (PARTITION BY spec ORDER BY t) AS i, count(*) OVER w AS n, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM ({_THREE}) WINDOW w AS (PARTITION BY spec)), q AS (SELECT spec, max(n) AS n, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM z GROUP BY 1)"


@query(f"""WITH {_CENTRED}, k AS (SELECT spec, c.i - a.i AS k, sum(a.x * c.x) AS ax, sum(a.y * c.y) AS ay FROM z a JOIN z c USING (spec) WHERE c.i - a.i BETWEEN 1 AND greatest(1, a.n // 5) GROUP BY 1, 2),
 e AS (SELECT spec, max(n) AS n, max(sxy / sqrt(sxx * syy)) AS r, (1 + 2 * sum(ax / sxx * ay / syy)) / max(n) AS inv FROM k JOIN q USING (spec) GROUP BY 1),
 f AS (SELECT spec, n, r, CASE WHEN inv <= 0 THEN n::DOUBLE ELSE least(n::DOUBLE, 1 / inv) END AS ne FROM e)
 SELECT spec, round(r, 6) AS correlation, n::INT AS n_obs, round(ne, 6) AS n_effective, round(r * sqrt((ne - 2) / (1 - r * r)), 6) AS t_statistic FROM f""")
def effective_n_points(spark, sf_dir):
    return _rounded(inference.effective_n(stacked(spark, sf_dir), ["spec"]), ["spec", "n_obs"], "correlation", "n_effective", "t_statistic")


@query(f"""WITH {_CENTRED}, e AS (SELECT spec, i, n, x / sqrt(sxx / (n - 1)) AS x, y / sqrt(syy / (n - 1)) AS y, (y - sxy / sxx * x) AS e FROM z JOIN (SELECT spec, sxx, syy, sxy FROM q) USING (spec)),
 m AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(e) OVER w AS e1 FROM e WINDOW w AS (PARTITION BY spec ORDER BY i)),
 h AS (SELECT spec, greatest(-0.99::DOUBLE, least(0.99::DOUBLE, sum(e * e1) / sum(e1 * e1))) AS rho FROM m GROUP BY 1),
 d AS (SELECT spec, n, CASE WHEN i = 1 THEN sqrt(1 - rho * rho) ELSE 1 - rho END AS c, CASE WHEN i = 1 THEN x * sqrt(1 - rho * rho) ELSE x - rho * x1 END AS x, CASE WHEN i = 1 THEN y * sqrt(1 - rho * rho) ELSE y - rho * y1 END AS y FROM m JOIN h USING (spec)),
 a AS (SELECT spec, max(n) AS n, sum(c * c) AS cc, sum(c * x) AS cx, sum(x * x) AS xx, sum(c * y) AS cy, sum(x * y) AS xy, sum(y * y) AS yy FROM d GROUP BY 1),
 s AS (SELECT *, (cc * xy - cx * cy) / (cc * xx - cx * cx) AS b, (xx * cy - cx * xy) / (cc * xx - cx * cx) AS b0 FROM a)
 SELECT spec, round(b / sqrt((yy - b0 * cy - b * xy) / (n - 2) * cc / (cc * xx - cx * cx)), 6) AS t_statistic, n::INT AS n_obs FROM s""")
def prais_winsten_points(spark, sf_dir):
    return _rounded(inference.prais_winsten(stacked(spark, sf_dir), ["spec"]), ["spec", "n_obs"], "t_statistic")


_ERAS = f"""z AS (SELECT break_year, late, t, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS x, (y - avg(y) OVER w) / stddev_samp(y) OVER w AS y FROM (SELECT k AS break_year, year(t) >= k AS late, t, p AS x, n AS y FROM {MONTHS_SQL}, (VALUES (1997), (1998), (1999), (2000)) v(k)) WINDOW w AS (PARTITION BY break_year, late)),
 b AS (SELECT break_year, late, sum(x * y) / sum(x * x) AS slope, sum(x * x) AS sxx FROM z GROUP BY 1, 2),
 s AS (SELECT break_year, row_number() OVER (PARTITION BY break_year ORDER BY t) AS i, CASE WHEN late THEN 1 ELSE -1 END * x * (y - slope * x) / sxx AS s FROM z JOIN b USING (break_year, late)),
 c AS (SELECT break_year, count(*) AS n, {_BANDWIDTH.replace('n /', 'count(*) /')} AS lags FROM s GROUP BY 1),
 g AS (SELECT break_year, max(n) AS n, sum(a.s * e.s * (1 - abs(a.i - e.i) / (lags + 1.0::DOUBLE))) AS v FROM s a JOIN s e USING (break_year) JOIN c USING (break_year) WHERE abs(a.i - e.i) <= lags GROUP BY 1)"""


@query(f"WITH {_ERAS} SELECT break_year, round(d, 6) AS difference, round(sqrt(v * n / (n - 4)), 6) AS standard_error FROM g JOIN (SELECT break_year, sum(CASE WHEN late THEN slope ELSE -slope END) AS d FROM b GROUP BY 1) USING (break_year)")
def era_points(spark, sf_dir):
    m = inference.pairs(months(spark, sf_dir), "p", "n", "t")
    return _rounded(inference.break_sensitivity(m, F.year("t"), [1997, 1998, 1999, 2000]), ["break_year"], "difference", "standard_error")


@query("""WITH l AS (SELECT o_custkey % 5 AS unit, date_trunc('month', o_orderdate)::DATE AS t, avg(o_totalprice) / 1000 AS y, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2),
 z AS (SELECT t, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM l), b AS (SELECT count(*) AS n, sum(x * y) / sum(x * x) AS slope, sum(x * x) AS sxx FROM z),
 s AS (SELECT row_number() OVER (ORDER BY t) AS i, sum(x * (y - slope * x) / sxx) AS s FROM z, b GROUP BY t), g AS (SELECT sum(a.s * c.s * (1 - abs(a.i - c.i) / 5.0::DOUBLE)) AS v FROM s a, s c WHERE abs(a.i - c.i) <= 4)
 SELECT round(slope, 6) AS slope, round(sqrt(v * n / (n - 2)), 6) AS standard_error, n::INT AS n_obs FROM b, g""")
def driscoll_kraay_points(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 5).alias("unit"), F.to_date(F.trunc(F.to_date("o_orderdate"), "month")).alias("t")).agg((F.avg("o_totalprice") / 1000).alias("y"), F.count("*").cast("double").alias("x"))
    return _rounded(inference.panel_regression(o.withColumn("g", F.lit(1)), ["g"], 4), ["n_obs"], "slope", "standard_error")


_RESPONSES = f"""SELECT h AS spec, t, x, CASE h {' '.join(f'WHEN {h} THEN h{h}' for h in range(1, 9))} END - o AS y, c1, c2, s, s * x AS sx FROM (SELECT t, f AS x, n AS s, p / 1000 AS o, (p - lag(p) OVER w) / 1000 AS c1, lag(f) OVER w AS c2, {', '.join(f'lead(p / 1000, {h}) OVER w AS h{h}' for h in range(1, 9))} FROM {MONTHS_SQL} WINDOW w AS (ORDER BY t)), range(1, 9) r(h)"""
_PROJECTED = f"SELECT * FROM ({_RESPONSES}) WHERE y IS NOT NULL AND c1 IS NOT NULL"
_PROJECTION_LAGS = f"greatest({_BANDWIDTH}, spec::INT - 1)"


@query(f"SELECT spec::INT AS h, round(a.slope, 3) AS slope, round(a.se, 3) AS standard_error, round(i.slope, 3) AS interaction, a.n_obs, a.lags FROM {_hac(_PROJECTED, _PROJECTION_LAGS, ('c1', 'c2', 's', 'sx'), False)} a JOIN {_hac(_PROJECTED.replace('*', 'spec, t, y, sx AS x, c1, c2, s, x AS own', 1), _PROJECTION_LAGS, ('c1', 'c2', 's', 'own'), False)} i USING (spec)")
def projection_points(spark, sf_dir):
    m = months(spark, sf_dir).withColumn("p", F.col("p") / 1000)
    out = inference.local_projections(m, "t", "f", "p", 8, interact="n")  # slopes are of the order of a thousand: nine digits
    return out.select("h", "n_obs", "lags", *[F.round(c, 3).alias(c) for c in ("slope", "standard_error", "interaction")])


@query(f"SELECT positive, n, round(list_sum(list_transform(range(positive, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2)))), 6) AS p FROM (SELECT count(*) FILTER (dp > 0)::BIGINT AS positive, count(*)::BIGINT AS n FROM {_CHANGES} WHERE dp IS NOT NULL)")
def sign_test_points(spark, sf_dir):
    rises = _changes(spark, sf_dir).where("dp is not null").select((F.col("dp") > 0).alias("up"))
    return _rounded(inference.sign_test(rises, "up"), ["positive", "n"], "p")


_P = "(SELECT c_mktsegment AS kind, CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 97) / 500.0::DOUBLE END AS p_value FROM customer)"


@query(f"SELECT kind, count(*)::BIGINT AS n_specs, count(p_value)::BIGINT AS n_estimated, count(*) FILTER (p_value < 0.05)::BIGINT AS n_significant FROM {_P} GROUP BY 1")
def spec_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_custkey") % 97 / F.lit(500.0)).alias("p_value"))
    return inference.spec_counts(c, ["kind"])

"""Scans, joins, set operations, shapes and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import ordered, panel as panels, quality, relational, sampling
from .catalogue import PANEL_SQL, panel, query, r6, table

_TERMS = [("first", "1995-01-01", "1996-12-31"), ("second", "1996-12-01", "1998-06-30"), ("third", "1998-07-15", "2000-01-01"), ("last", "2000-01-02", None)]
_TERMS_SQL = "(VALUES ('first', DATE '1995-01-01', DATE '1996-12-31', 1), ('second', DATE '1996-12-01', DATE '1998-06-30', 2), ('third', DATE '1998-07-15', DATE '2000-01-01', 3), ('last', DATE '2000-01-02', NULL::DATE, 4)) t(holder, s, e, k)"
_SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query("SELECT o_orderkey, printf('doc_%06d', row_number() OVER (ORDER BY d NULLS LAST, o_custkey NULLS LAST, o_orderkey NULLS LAST)) AS speech_id FROM " + PANEL_SQL)
def clean_ids(spark, sf_dir):
    return panels.numbered(panel(spark, sf_dir).select("o_orderkey", "d", "o_custkey"), ["d", "o_custkey", "o_orderkey"], width=6).select("o_orderkey", "speech_id")


@query(f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> ''))::INT AS n_words, sha256(array_to_string(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '')[1:50], ' ')) AS excerpt_sha FROM documents")
def excerpt_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.sha2(text.excerpt(F.col("text"), 50), 256).alias("excerpt_sha"))


@query("""SELECT * FROM (SELECT 'c_mktsegment' AS "column", count(*) FILTER (c_mktsegment IS NULL)::BIGINT AS n_null, round(count(*) FILTER (c_mktsegment IS NULL)::DOUBLE / count(*), 6) AS share_null FROM customer LEFT JOIN orders ON false
 UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL)::BIGINT, round(count(*) FILTER (o_orderkey IS NULL)::DOUBLE / count(*), 6) FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F')
 WHERE "column" <> 'c_mktsegment' UNION ALL SELECT 'c_name', 0::BIGINT, 0.0::DOUBLE""")
def null_audit(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    out = quality.null_audit(c.join(o, c["c_custkey"] == o["o_custkey"], "left"), ["o_orderkey", "c_name"])
    return out.select("column", "n_null", r6(F.col("share_null")).alias("share_null"))


@query("SELECT sum(k)::BIGINT AS n_rows, sum(k - 1)::BIGINT AS n_repeated, coalesce(sum(k) FILTER (k > 1), 0)::BIGINT AS n_involved FROM (SELECT count(*) AS k FROM orders GROUP BY o_custkey, o_orderdate)")
def dup_audit(spark, sf_dir):
    return quality.duplicate_audit(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def value_share(spark, sf_dir):
    out = relational.value_shares(table(spark, sf_dir, "orders"), "o_orderpriority")
    return out.select("o_orderpriority", "n", r6(F.col("share")).alias("share"))


@query("SELECT o_custkey, count(*)::BIGINT AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_values(spark, sf_dir):
    return relational.top_values(table(spark, sf_dir, "orders"), "o_custkey", 20)


@query("SELECT c_custkey, c_mktsegment, round(avg_price, 6) AS avg_price FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS avg_price FROM orders GROUP BY 1) USING (c_custkey)")
def left_join_gate(spark, sf_dir):
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("avg_price"))
    out = relational.join_one_to_one(table(spark, sf_dir, "customer"), right, ["c_custkey"])
    return out.select("c_custkey", "c_mktsegment", r6(F.col("avg_price")).alias("avg_price"))


@query("SELECT a.o_custkey, a.n AS n_urgent, b.n AS n_low FROM (SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b USING (o_custkey)")
def inner_suffix_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderpriority") == p).groupBy("o_custkey").agg(F.count("*").alias("n")) for p in ("1-URGENT", "5-LOW"))
    return relational.join_suffixed(a, b, ["o_custkey"], ("_urgent", "_low"))


@query("""SELECT coalesce(a.d, b.d, c.d) AS d, a.n AS n_orders, b.n AS n_shipped, c.n AS n_events FROM (SELECT o_orderdate::DATE AS d, count(*)::BIGINT AS n FROM orders GROUP BY 1) a
 FULL JOIN (SELECT l_shipdate::DATE AS d, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) b ON a.d = b.d FULL JOIN (SELECT ts::DATE AS d, count(*)::BIGINT AS n FROM events GROUP BY 1) c ON coalesce(a.d, b.d) = c.d""")
def full_outer_align(spark, sf_dir):
    def daily(name, at, n):
        return table(spark, sf_dir, name).groupBy(F.to_date(at).alias("d")).agg(F.count("*").alias(n))

    return relational.align([daily("orders", "o_orderdate", "n_orders"), daily("lineitem", "l_shipdate", "n_shipped"), daily("events", "ts", "n_events")], "d")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.semi(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.anti(table(spark, sf_dir, "customer"), ids, "c_custkey").select("c_custkey", "c_name")


@query(f"SELECT o_orderkey, arg_max(holder, k) AS holder FROM {PANEL_SQL} LEFT JOIN {_TERMS_SQL} ON d >= s AND (e IS NULL OR d <= e) GROUP BY o_orderkey")
def range_join_office(spark, sf_dir):
    return relational.office_holders(panel(spark, sf_dir), "d", _TERMS, "holder").select("o_orderkey", "holder")


@query(f"SELECT o_orderkey, arg_max(holder, k) AS holder FROM {PANEL_SQL} LEFT JOIN {_TERMS_SQL} ON d >= s AND (e IS NULL OR d <= e) GROUP BY o_orderkey")
def range_join_table(spark, sf_dir):
    terms = spark.createDataFrame([(n, a, b, k) for k, (n, a, b) in enumerate(_TERMS)], "holder string, s string, e string, k int").select("holder", F.to_date("s").alias("s"), F.to_date("e").alias("e"), "k")
    return relational.range_join(panel(spark, sf_dir).select("o_orderkey", "d"), "d", terms, "s", "e", "k").select("o_orderkey", "holder")


_EVENTS_SQL = f"(SELECT DISTINCT d AS e FROM {PANEL_SQL} WHERE o_orderkey % 97 = 0)"


@query(f"""WITH ev AS (SELECT e, lag(e) OVER (ORDER BY e) AS p, (row_number() OVER (ORDER BY e) - 1)::INT AS k FROM {_EVENTS_SQL})
 SELECT k AS event_index, e AS event_date, p AS window_start, count(*)::BIGINT AS n_speeches, sum(att)::BIGINT AS n_attending, round(sum(att * outl)::DOUBLE / nullif(sum(att), 0), 6) AS out_pi, date_diff('day', p, e)::INT AS window_days
 FROM {PANEL_SQL} x ASOF JOIN ev ON x.d < ev.e GROUP BY ALL""")
def asof_forward_window(spark, sf_dir):
    p = panel(spark, sf_dir)
    events = p.where("o_orderkey % 97 = 0").select(F.col("d").alias("e"))
    out = relational.next_event(p, "d", events, "e").groupBy("event_index", "event_date", "window_start").agg(F.count("*").alias("n_speeches"), F.sum("att").alias("n_attending"), r6(F.try_divide(F.sum(F.col("att") * F.col("outl")).cast("double"), F.sum("att"))).alias("out_pi"))
    return out.withColumn("event_index", F.col("event_index").cast("int")).withColumn("window_days", F.datediff("event_date", "window_start"))


@query("""SELECT d, part, round(v, 6) AS v FROM (SELECT o_orderdate::DATE AS d, 'price' AS part, avg(o_totalprice) AS v FROM orders WHERE o_orderdate::DATE < DATE '1997-01-01' OR o_orderdate::DATE >= DATE '1999-01-01' GROUP BY 1
 UNION ALL SELECT o_orderdate::DATE, 'count', count(*)::DOUBLE FROM orders WHERE o_orderdate::DATE >= DATE '1997-01-01' AND o_orderdate::DATE < DATE '1999-01-01' GROUP BY 1)""")
def splice_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d"))
    a = o.agg(F.lit("price").alias("part"), F.avg("o_totalprice").alias("v"))
    b = o.agg(F.lit("count").alias("part"), F.count("*").cast("double").alias("v"))
    return relational.splice(a, b, "d", "1997-01-01", "1999-01-01").select("d", "part", r6(F.col("v")).alias("v"))


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer)")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))).distinct()


@query("SELECT 'missing' AS side, c_custkey FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'unexpected', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_diff_both(spark, sf_dir):
    return quality.id_coverage(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT k FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")
    return a.intersect(b)


@query("SELECT NOT bool_or(o_orderstatus NOT IN ('F', 'O')) AS ok, array_to_string(list_sort(list(DISTINCT o_orderstatus) FILTER (o_orderstatus NOT IN ('F', 'O'))), ',') AS extra FROM orders")
def domain_check(spark, sf_dir):
    return quality.within_domain(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"]).select("ok", F.array_join("extra", ",").alias("extra"))


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'fr') AND (regexp_matches(text, '(?i)apache|general public') OR regexp_matches(source, '(?i)src1[0-2]')) ORDER BY n_chars DESC, doc_id LIMIT 25")
def keyword_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hit = text.contains_pattern([F.col("text")], "apache|general public") | text.contains_pattern([F.col("source")], "src1[0-2]")
    return d.where(F.col("lang").isin("en", "fr") & hit).orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "source")


@query("SELECT p.pos::INT AS pos, o_orderkey, o_custkey FROM (VALUES (0, 7), (1, 3), (2, 5)) p(pos, k) JOIN orders ON o_orderkey = k")
def ordered_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ids = [7, 3, 5]
    found = relational.lookup(o, ids, "o_orderkey")
    return found.withColumn("pos", (F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("o_orderkey")) - 1).cast("int"))


@query("SELECT o_orderstatus, max(n) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(n) FILTER (o_orderpriority = '5-LOW') AS low FROM (SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query(f"SELECT o_orderkey, variable, value::INT AS value FROM (SELECT o_orderkey, 'att' AS variable, att AS value FROM {PANEL_SQL} UNION ALL SELECT o_orderkey, 'outl', outl FROM {PANEL_SQL})")
def unpivot_long(spark, sf_dir):
    return relational.unpivot_codes(panel(spark, sf_dir), ["o_orderkey"], ["att", "outl"])


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, round(quantile_cont(l_quantity, 0.25), 6) AS p25, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.75), 6) AS p75, max(l_quantity) AS max FROM lineitem GROUP BY 1")
def describe_exact(spark, sf_dir):
    out = relational.describe(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", "min", "max", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "p25", "p50", "p75")])


@query("SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def keep_first(spark, sf_dir):
    return relational.first_rows(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc("c_acctbal"), "c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT 'price_positive' AS "check", count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) = 0 AS ok, count(*) FILTER (NOT coalesce(o_totalprice > 0, false))::BIGINT AS n_wrong FROM orders
 UNION ALL SELECT 'status_final', count(*) FILTER (o_orderstatus <> 'F') = 0, count(*) FILTER (o_orderstatus <> 'F')::BIGINT FROM orders UNION ALL SELECT 'row_count', count(*) = 15000, abs(count(*) - 15000)::BIGINT FROM orders""")
def check_table(spark, sf_dir):
    return quality.check_table(table(spark, sf_dir, "orders"), {"price_positive": F.col("o_totalprice") > 0, "status_final": F.col("o_orderstatus") == "F"}, 15000)


@query("SELECT stratum, n, greatest(1, least(n, round_even(60.0::DOUBLE * n / sum(n) OVER (), 0)::BIGINT)) AS base FROM (SELECT o_orderpriority || '_' || o_orderstatus AS stratum, count(*)::BIGINT AS n FROM orders GROUP BY 1)")
def stratum_sizes(spark, sf_dir):
    from pyspark.sql import Window

    s = table(spark, sf_dir, "orders").groupBy(F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("stratum")).agg(F.count("*").alias("n"))
    share = F.bround(F.lit(60.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 0).cast("long")
    return s.withColumn("base", F.greatest(F.lit(1).cast("long"), F.least("n", share)))


@query()
def stratified_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("stratum", F.concat_ws("_", "o_orderpriority", "o_orderstatus"))
    return sampling.draw(o, sampling.allocate(sampling.sizes(o), 60), "o_orderkey").select("o_orderkey", "stratum")


@query("SELECT event_type, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("r", F.from_json("props", "k int", {"mode": "FAILFAST"}))
    return e.groupBy("event_type").agg(r6(F.avg("r.k")).alias("mean_k"), F.count("*").alias("n"))


@query("SELECT * FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)")
def event_windows(spark, sf_dir):
    from ..streaming import windows

    out = windows.windowed(table(spark, sf_dir, "events"))
    return out.select("window_start", "event_type", "n", r6(F.col("total")).alias("total"))


@query(f"SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey::VARCHAR) AS ids FROM {PANEL_SQL} WHERE att <> att_b GROUP BY 1")
def joined_ids(spark, sf_dir):
    return panel(spark, sf_dir).where("att <> att_b").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), " ").alias("ids"))


@query(f"SELECT a, b, round(r, 6) AS r FROM (SELECT 'att' AS a, 'outl' AS b, corr(att, outl) AS r FROM {PANEL_SQL} UNION ALL SELECT 'att', 'o_totalprice', corr(att, o_totalprice) FROM {PANEL_SQL} UNION ALL SELECT 'outl', 'o_totalprice', corr(outl, o_totalprice) FROM {PANEL_SQL})")
def pair_correlations(spark, sf_dir):
    return relational.pair_correlations(panel(spark, sf_dir), ["att", "outl", "o_totalprice"]).select("a", "b", r6(F.col("r")).alias("r"))


@query("SELECT n_name, strftime(d, '%Y-%m') AS month, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, o_orderdate::DATE AS d FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def chained_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name", ordered.month_label(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 290001)), 6) AS clipped, round_even(o_orderkey / 2.0::DOUBLE, 0)::BIGINT AS halves, printf('%+d', outl) AS sign, CASE o_custkey % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'other' END AS name,
 (att + outl + att_b)::INT AS total, contains(o_orderkey::VARCHAR, '7') AS has_seven, (date_trunc('quarter', d) - INTERVAL 3 MONTH)::DATE AS before FROM """ + PANEL_SQL)
def scalar_functions(spark, sf_dir):
    p = panel(spark, sf_dir)
    key = F.col("o_orderkey")
    return p.select("o_orderkey", r6(scalars.clip(F.col("o_totalprice") / 290001, 0.0, 1.0)).alias("clipped"), scalars.round_even(key / F.lit(2.0)).cast("long").alias("halves"), scalars.signed(F.col("outl")).alias("sign"), scalars.mapped(F.col("o_custkey") % 3, {0: "zero", 1: "one"}, "other").alias("name"), scalars.row_sum([F.col("att"), F.col("outl"), F.col("att_b")]).alias("total"), scalars.contained(F.lit("7"), key.cast("string")).alias("has_seven"), scalars.shift_quarters(F.col("d"), -1).alias("before"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice NULLS FIRST, o_orderkey NULLS FIRST)::BIGINT AS place FROM orders")
def mixed_sort(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return panels.placed(o, [F.desc("o_orderpriority"), F.asc("o_totalprice"), F.asc("o_orderkey")]).drop("o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC NULLS LAST, c_custkey LIMIT 25")
def largest_magnitudes(spark, sf_dir):
    """A top-k report."""
    return relational.by_magnitude(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").limit(25)


@query("SELECT p, round(quantile_cont(o_totalprice, p), 6) AS v FROM orders, (SELECT unnest([0.0::DOUBLE, 0.1, 0.5, 0.999, 1.0]) AS p) GROUP BY p".replace("quantile_cont(o_totalprice, p)", "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(o_totalprice, {p})" for p in (0.0, 0.1, 0.5, 0.999, 1.0)) + " END"))
def quantiles_by_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(p, relational.quantile(o, "o_totalprice", p)) for p in (0.0, 0.1, 0.5, 0.999, 1.0)], "p double, v double").select("p", r6(F.col("v")).alias("v"))


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_final, bool_and(o_totalprice > 50000) AS all_large, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY 1")
def any_all_extremes(spark, sf_dir):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_final"), F.bool_and(F.col("o_totalprice") > 50000).alias("all_large"), F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@query("SELECT year, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(1995, 2002))::INT AS year) LEFT JOIN (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1998 GROUP BY 1) USING (year)")
def year_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("year(o_orderdate) <> 1998").select(F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("contents"))
    return quality.corpus_audit(o, "date", "title", "contents")["years"]

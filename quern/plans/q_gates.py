"""Samples and their sheets, gates, rounds of classification, and codes of texts, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import coders, lexicon, text
from ..operators import agreement, inference, measures, quality, sampling
from ..sources import shared, sinks
from ..streaming import classify
from .catalogue import PANEL_SQL, panel, query, r6, table
from .q_agreement import _kappa_sql, _pairs
from .q_relational import _SPACE
from .q_text import _NET, DOWN, NEGATORS, TOPIC, UP, _count, _list, _tokens

# Samples


@query(f"""SELECT o_orderkey, era, attention_count, era || '_n' || attention_count AS stratum FROM (SELECT *, (att + att_b)::INT AS attention_count, CASE WHEN year(d) < 1998 THEN 'early' ELSE 'late' END AS era FROM {PANEL_SQL})
 WHERE dir >= 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def eligible_frame(spark, sf_dir):
    prior = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    era = F.when(F.year("d") < 1998, "early").otherwise("late")
    return sampling.eligible(panel(spark, sf_dir), [prior], "o_custkey", ["att", "att_b"], F.col("dir") >= 0, era).select("o_orderkey", "era", "attention_count", "stratum")


_ASKED = 101


@query(f"""WITH RECURSIVE s AS (SELECT list(stratum ORDER BY stratum) AS names, list(n ORDER BY stratum) AS avail, list(n * w ORDER BY stratum) AS mass, sum(n * w) AS total FROM (SELECT c_mktsegment || '_' || printf('%02d', c_nationkey) AS stratum, count(*)::BIGINT AS n, (CASE WHEN c_nationkey < 3 THEN 40 ELSE 1 END)::DOUBLE AS w FROM customer GROUP BY 1, 3)),
 step AS (SELECT names, avail, list_transform(range(1, len(names) + 1), lambda i: least(round_even({_ASKED} * mass[i] / total, 0)::BIGINT, avail[i])) AS got FROM s
 UNION ALL SELECT names, avail, list_transform(range(1, len(names) + 1), lambda i: got[i] + CASE WHEN i = best THEN move ELSE 0 END) FROM (
  SELECT *, list_position(room, list_max(room)) AS best FROM (SELECT *, CASE WHEN list_sum(got) < {_ASKED} THEN 1 ELSE -1 END AS move, CASE WHEN list_sum(got) < {_ASKED} THEN list_transform(range(1, len(names) + 1), lambda i: avail[i] - got[i]) ELSE got END AS room FROM step WHERE list_sum(got) <> {_ASKED})))
 SELECT unnest(names) AS stratum, unnest(got)::BIGINT AS n FROM step WHERE list_sum(got) = {_ASKED}""")
def allocation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("stratum", F.concat_ws("_", "c_mktsegment", F.format_string("%02d", "c_nationkey")))
    available = sampling.sizes(c)
    got = sampling.allocate(available, _ASKED, {s: 40.0 if int(s[-2:]) < 3 else 1.0 for s in available})
    return spark.createDataFrame(sorted(got.items()), "stratum string, n long")


@query("SELECT o_orderpriority || '_' || o_orderstatus AS stratum, least(count(*), 7)::BIGINT AS n, least(count(*), 7)::BIGINT AS n_distinct FROM orders GROUP BY 1")
def drawn_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("stratum", F.concat_ws("_", "o_orderpriority", "o_orderstatus"))
    drawn = sampling.draw(o, {s: min(n, 7) for s, n in sampling.sizes(o).items()}, "o_orderkey")
    return drawn.groupBy("stratum").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"))


@query(f"SELECT year(d)::INT AS year, count(*) FILTER (att = 0)::BIGINT AS att_0, count(*) FILTER (att = 1)::BIGINT AS att_1, count(*) FILTER (outl = -1)::BIGINT AS outl_down, count(*) FILTER (outl = 1)::BIGINT AS outl_up FROM {PANEL_SQL} GROUP BY 1")
def coverage_floor(spark, sf_dir):
    p = sampling.require_coverage(panel(spark, sf_dir), ["att", "att_b"], ["outl", "outl_b"])
    cells = {"att_0": F.col("att") == 0, "att_1": F.col("att") == 1, "outl_down": F.col("outl") == -1, "outl_up": F.col("outl") == 1}
    return p.groupBy(F.year("d").alias("year")).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])


@query(f"SELECT o_orderkey, d, NULL::VARCHAR AS att_coded, NULL::VARCHAR AS outl_coded, att, outl FROM {PANEL_SQL}")
def blind_sheet(spark, sf_dir):
    sheet, key = sampling.blind_sheet(panel(spark, sf_dir), ["o_orderkey", "d"], ["att", "outl"], ["att_coded", "outl_coded"])
    return sheet.join(key, "o_orderkey")


_WORDS = f"len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> ''))"


@query(f"SELECT doc_id, n AS words_full, least(n, 50)::INT AS words_seen, n > 50 AS truncated, sha256(text) AS text_sha, NULL::VARCHAR AS code FROM (SELECT doc_id, text, {_WORDS}::INT AS n FROM documents)")
def full_text_sheet(spark, sf_dir):
    sheet = sampling.full_text_sheet(table(spark, sf_dir, "documents"), "text", 50, ["doc_id"], ["code"])
    return sheet.select("doc_id", "words_full", "words_seen", "truncated", F.sha2("text", 256).alias("text_sha"), "code")


@query("SELECT 'treated' AS \"group\", count(*)::BIGINT AS n, count(DISTINCT o_orderkey)::BIGINT AS n_distinct, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_marked FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'control', 12, 12, 0")
def treated_and_controls(spark, sf_dir):
    marked = F.col("o_orderstatus") == "P"
    out = sampling.treated_and_controls(table(spark, sf_dir, "orders"), marked, "o_orderkey")
    return out.groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"), F.count_if(marked).alias("n_marked"))


# Agreement


@query(f"""SELECT a.variable, a.n, a.agreement, a.kappa, b.agreement AS agreement_before, b.kappa AS kappa_before FROM ({_kappa_sql('TRUE')}) a LEFT JOIN ({_kappa_sql("variable = 'att' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")}) b USING (variable)""")
def ceiling_table(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    earlier = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    before = agreement.agreement_table(pairs.where("variable = 'att'").join(earlier, "o_custkey", "left_semi"))
    out = agreement.ceiling(agreement.agreement_table(pairs), before)
    return out.select("variable", "n", *[r6(F.col(c)).alias(c) for c in ("agreement", "kappa", "agreement_before", "kappa_before")])


@query(f"""SELECT year, n_one AS n_true_one, n_zero AS n_true_zero, round(s, 6) AS sensitivity, round(p, 6) AS specificity, round(q, 6) AS coded_share, round(CASE WHEN s + p - 1 > 1e-6 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (q - (1 - p)) / (s + p - 1))) ELSE q END, 6) AS corrected, TRUE AS inside
 FROM (SELECT year(d)::INT AS year, count(*) FILTER (att_b = 1)::BIGINT AS n_one, count(*) FILTER (att_b = 0)::BIGINT AS n_zero, avg(CASE WHEN att_b = 1 THEN att::DOUBLE END) AS s, avg(CASE WHEN att_b = 0 THEN 1 - att::DOUBLE END) AS p, avg(att::DOUBLE) AS q FROM {PANEL_SQL} GROUP BY 1)""")
def rate_table(spark, sf_dir):
    pairs = panel(spark, sf_dir).select(F.year("d").alias("year"), F.col("att").alias("a"), F.col("att_b").alias("b"))
    ordered = (F.col("sens_low") < F.col("sensitivity")) & (F.col("sensitivity") < F.col("sens_high")) & (F.col("corrected_low") <= F.col("corrected")) & (F.col("corrected") <= F.col("corrected_high"))
    out = agreement.rate_table(pairs, ["year"]).withColumn("inside", ordered)
    return out.select("year", "n_true_one", "n_true_zero", *[r6(F.col(c)).alias(c) for c in ("sensitivity", "specificity", "coded_share", "corrected")], "inside")


@query(f"SELECT year(d)::INT AS year, round(avg(att::DOUBLE), 6) AS share FROM {PANEL_SQL} GROUP BY 1")
def parameters_round_trip(spark, sf_dir):
    """Shares by year, written as JSON to the shared folder and read again."""
    shares = panel(spark, sf_dir).groupBy(F.year("d").alias("year")).agg(r6(measures.share(F.col("att"))).alias("share"))
    path = shared.new_path(spark, "parameters")
    shares.write.json(path)
    return spark.read.schema("year int, share double").json(path)


# Gates


@query("""SELECT 'columns_exact' AS gate, list_sort(list(column_name)) = ['r_name', 'r_regionkey'] AS passed FROM (DESCRIBE region)
 UNION ALL SELECT 'columns_missing', list_contains(list(column_name), 'r_comment') FROM (DESCRIBE region)
 UNION ALL SELECT 'unique', count(*) = count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'unique_customers', count(*) = count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'bounds', count(*) FILTER (NOT o_totalprice BETWEEN 0 AND 1e9) = 0 FROM orders UNION ALL SELECT 'bounds_narrow', count(*) FILTER (NOT o_totalprice BETWEEN 0 AND 1e5) = 0 FROM orders
 UNION ALL SELECT 'matched', count(*) FILTER (n_name IS NULL) = 0 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'matched_orders', count(*) FILTER (o_orderkey IS NULL) = 0 FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'
 UNION ALL SELECT 'same_count', (SELECT count(*) FROM customer) = count(*) FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'same_count_orders', (SELECT count(*) FROM customer) = count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey
 UNION ALL SELECT 'first_year', min(year(o_orderdate)) = 1995 FROM orders UNION ALL SELECT 'first_year_late', min(year(o_orderdate)) = 1996 FROM orders
 UNION ALL SELECT 'names', count(DISTINCT o_orderstatus) = 3 FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') UNION ALL SELECT 'names_unknown', count(DISTINCT o_orderstatus) = 2 FROM orders WHERE o_orderstatus IN ('F', 'Z')
 UNION ALL SELECT 'flags', TRUE UNION ALL SELECT 'flags_wrong', FALSE
 UNION ALL SELECT 'gap_free', count(DISTINCT date_trunc('month', o_orderdate)) = date_diff('month', min(o_orderdate), max(o_orderdate)) + 1 FROM orders UNION ALL SELECT 'gap_free_cut', FALSE
 UNION ALL SELECT 'reproduced', TRUE UNION ALL SELECT 'reproduced_other', FALSE""")
def gate_results(spark, sf_dir):
    region, nation, customer, orders = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    bought = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    partly = customer.join(orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left")
    years = orders.select(F.year("o_orderdate").alias("year"))
    p = panel(spark, sf_dir)
    flagged = p.withColumn("flag", F.when(F.col("att") == F.col("att_b"), "agree").otherwise("differ"))
    months = p.select(F.to_date(F.trunc("d", "month")).alias("m")).distinct()
    shares = p.groupBy(F.year("d").alias("year")).agg(F.avg(F.col("att").cast("double")).alias("v"), (F.sum("att") / F.count("att")).alias("again"))
    stored = shares.select("year", F.col("again").alias("v"))
    return quality.outcomes(spark, {
        "columns_exact": lambda: quality.require_columns(region, ["r_regionkey", "r_name"], True), "columns_missing": lambda: quality.require_columns(region, ["r_comment"]),
        "unique": lambda: quality.require_unique(orders, ["o_orderkey"]), "unique_customers": lambda: quality.require_unique(orders, ["o_custkey"]),
        "bounds": lambda: quality.require_between(orders, "o_totalprice", 0, 1e9), "bounds_narrow": lambda: quality.require_between(orders, "o_totalprice", 0, 1e5),
        "matched": lambda: quality.require_matched(home, "n_name"), "matched_orders": lambda: quality.require_matched(partly, "o_orderkey"),
        "same_count": lambda: quality.require_same_count(customer, home), "same_count_orders": lambda: quality.require_same_count(customer, bought),
        "first_year": lambda: quality.require_first(years, "year", 1995), "first_year_late": lambda: quality.require_first(years, "year", 1996),
        "names": lambda: quality.require_names(orders, "o_orderstatus", ["F", "O", "P"]), "names_unknown": lambda: quality.require_names(orders, "o_orderstatus", ["F", "Z"]),
        "flags": lambda: agreement.require_flags_consistent(flagged, "att", "att_b", "flag"), "flags_wrong": lambda: agreement.require_flags_consistent(flagged.withColumn("flag", F.lit("agree")), "att", "att_b", "flag"),
        "gap_free": lambda: quality.require_gap_free(months, "m", 1), "gap_free_cut": lambda: quality.require_gap_free(months.where("month(m) <> 5"), "m", 1),
        "reproduced": lambda: inference.require_reproduced(shares, stored, ["year"], "v"), "reproduced_other": lambda: inference.require_reproduced(shares, stored.withColumn("v", F.col("v") + 1e-6), ["year"], "v"),
    })


@query(f"SELECT doc_id, {_WORDS}::INT AS n_words FROM documents WHERE {_WORDS} < 200")
def short_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))
    return quality.short_texts(d, "n_words")


# Classification


def _coder(prompt: str) -> str:
    """Refuses some texts, answers some in no JSON, one in codes out of their domain; codes the others by their length."""
    n = len(prompt)
    if n % 7 == 0:
        raise ValueError("refused")
    if n % 7 == 1:
        return "no codes"
    codes = {v: n % 2 for v in coders.ATTENTION} | dict.fromkeys(coders.OUTLOOK, n % 2 * (n % 3 - 1))
    return json.dumps(codes | ({"growth_attention": 2} if n % 7 == 2 else {}))


_CODED = "(SELECT doc_id, lang, length(coalesce(text, '')) AS n FROM documents)"
_FAILED = "CASE n % 7 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'JSONDecodeError' WHEN 2 THEN 'ValueError' END"
_ONCE = classify.Retry(tries=2, seconds=0.0)


@query(f"SELECT doc_id, {_FAILED} AS error_type, CASE WHEN n % 7 > 2 THEN n % 2 END::INT AS inflation_attention, CASE WHEN n % 7 > 2 THEN n % 2 * (n % 3 - 1) END::INT AS growth_outlook FROM {_CODED}")
def classified(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify.classify(d, "text", _coder, _ONCE, keep=["doc_id"]).select("doc_id", "error_type", "inflation_attention", "growth_outlook")


@query(f"SELECT doc_id, 1::BIGINT AS n_signals, 0::BIGINT AS n_errors FROM {_CODED} WHERE n % 7 > 2 UNION ALL SELECT doc_id, 0, (CASE WHEN lang = 'en' THEN 2 ELSE 1 END)::BIGINT FROM {_CODED} WHERE n % 7 <= 2")
def resumed(spark, sf_dir):
    """Two rounds, the first over one language: what has codes is left alone in the second, what failed is tried and logged again."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    signals, errors = (shared.new_path(spark, f"round-{k}") for k in ("signals", "errors"))
    for part in (d.where("lang = 'en'"), d):
        classify.resume(part, "text", "doc_id", signals, errors, classifier=_coder, retry=_ONCE)
    both = spark.read.parquet(signals).select("doc_id", F.lit(1).alias("s")).unionByName(spark.read.parquet(errors).select("doc_id", F.lit(0).alias("s")))
    return both.groupBy("doc_id").agg(F.count_if(F.col("s") == 1).alias("n_signals"), F.count_if(F.col("s") == 0).alias("n_errors"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def appended_rounds(spark, sf_dir):
    """Orders, appended to one table status by status, and read again."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), shared.new_path(spark, "rounds")
    for part in (o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F' or o_orderstatus is null")):
        sinks.append(part, path)
    return spark.read.parquet(path)


# Texts


_SCORED = _NET.replace(_list(NEGATORS), _list(lexicon.NEGATORS))


@query(_SCORED + f" SELECT d.doc_id, len({_tokens('text')})::INT AS dict_n_words, round(coalesce({_count('text', TOPIC)} * 1000.0::DOUBLE / nullif(len({_tokens('text')}), 0), 0), 6) AS dens_own, round(coalesce(tone, 0), 6) AS tone_own, coalesce(n_sentences, 0)::INT AS n_sent_own FROM documents d LEFT JOIN t USING (doc_id) WHERE lang = 'en'")
def score_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    s = text.score(F.col("text"), {"own": TOPIC}, {"own": {"up": UP, "down": DOWN}})
    return d.select("doc_id", s["dict_n_words"].alias("dict_n_words"), r6(s["dens_own"]).alias("dens_own"), r6(s["tone_own"]).alias("tone_own"), s["n_sent_own"].alias("n_sent_own"))

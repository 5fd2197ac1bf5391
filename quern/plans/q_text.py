"""Text measurement over documents. Their words are invented, so function words stand in for the vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import agreement
from .catalogue import query, r6, table

TOPIC, UP, DOWN, NEGATORS = ["that", "this"], ["with", "on"], ["for", "is"], ["or", "the"]


def _list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]+')"


def _count(c: str, words: list[str]) -> str:
    return f"len(list_filter({_tokens(c)}, lambda x: x IN {_list(words)}))"


_SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(f"SELECT doc_id, len({_tokens('text')})::INT AS n_words FROM documents")
def token_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"(?U)\b\w+\b")).alias("n_words"))


@query(f"SELECT doc_id, en::INT AS english_markers, other::INT AS non_english_markers, other > en AS non_english FROM (SELECT doc_id, {_count('substr(text, 1, 4000)', lexicon.ENGLISH_MARKERS)} AS en, {_count('substr(text, 1, 4000)', lexicon.NON_ENGLISH_MARKERS)} AS other FROM documents)")
def language_flag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in text.language_flags(F.col("text")).items()])


@query(f"SELECT doc_id, round(coalesce({_count('text', TOPIC)} * 1000.0::DOUBLE / nullif(len({_tokens('text')}), 0), 0), 6) AS density FROM documents")
def topic_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(text.density(F.col("text"), TOPIC)).alias("density"))


@query(f"SELECT doc_id, len({_SENTENCES})::INT AS n_sentences FROM documents")
def sentence_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query(f"SELECT doc_id, len(list_filter({_SENTENCES}, lambda s: {_count('s', TOPIC)} > 0))::INT AS n_topic FROM documents")
def topic_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.topic_sentences(F.col("text"), TOPIC)).alias("n_topic"))


_DENSITIES = f"(SELECT doc_id, coalesce({_count('text', TOPIC)} * 1000.0::DOUBLE / nullif(len({_tokens('text')}), 0), 0) AS s FROM documents WHERE lang = 'en')"


@query(f"SELECT round(quantile_cont(s, 0.7), 6) AS cutoff FROM {_DENSITIES}")
def prevalence_threshold(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select(text.density(F.col("text"), TOPIC).alias("s"))
    return d.agg(r6(F.percentile("s", 0.7)).alias("cutoff"))


@query(f"SELECT doc_id, (s > (SELECT quantile_cont(s, 0.7) FROM {_DENSITIES}))::INT AS att FROM {_DENSITIES}")
def attention_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", text.density(F.col("text"), TOPIC).alias("s"))
    return agreement.code_attention(d, "s", 0.3, "att").select("doc_id", "att")


_NET = f"""WITH sen AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents WHERE lang = 'en'),
 own AS (SELECT doc_id, {_tokens('s')} AS w FROM sen WHERE {_count('s', TOPIC)} > 0),
 net AS (SELECT doc_id, list_sum(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] IN {_list(UP)} THEN 1 WHEN w[i] IN {_list(DOWN)} THEN -1 ELSE 0 END * CASE WHEN len(list_filter(w[greatest(1, i - 3):i - 1], lambda x: x IN {_list(NEGATORS)})) > 0 THEN -1 ELSE 1 END)) AS n FROM own),
 t AS (SELECT doc_id, coalesce(sum(n), 0)::DOUBLE / count(*) AS tone, count(*)::INT AS n_sentences FROM net GROUP BY 1)"""


@query(_NET + " SELECT d.doc_id, round(coalesce(tone, 0), 6) AS tone, coalesce(n_sentences, 0)::INT AS n_sentences FROM documents d LEFT JOIN t USING (doc_id) WHERE lang = 'en'")
def tone_native(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    t = text.tone(F.col("text"), TOPIC, UP, DOWN, NEGATORS)
    return d.select("doc_id", r6(t["tone"]).alias("tone"), t["n_sentences"].alias("n_sentences"))


@query()
def score_corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in text.score(F.col("text")).items()])


@query(f"SELECT doc_id, (CASE WHEN s > (SELECT quantile_cont(s, 0.7) FROM {_DENSITIES}) THEN 1 ELSE 0 END)::INT AS att, sha256(lower(array_to_string({_tokens('text')}[1:5], ' '))) AS opening FROM {_DENSITIES} JOIN documents USING (doc_id) WHERE s > 0")
def attending_openings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text", text.density(F.col("text"), TOPIC).alias("s"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return agreement.code_attention(d, "s", 0.3, "att").where("s > 0").select("doc_id", "att", F.sha2(F.array_join(F.slice(words, 1, 5), " "), 256).alias("opening"))


_OUTLOOK = _NET + f""", own2 AS (SELECT doc_id, s, coalesce(tone, 0) AS tone FROM {_DENSITIES} LEFT JOIN t USING (doc_id)), c AS (SELECT *, s > (SELECT quantile_cont(s, 0.7) FROM own2) AS a FROM own2),
 k AS (SELECT avg(a::INT::DOUBLE) AS share, count(*) FILTER (a) AS m FROM c), p AS (SELECT 0.8::DOUBLE - (1 - share) AS gap, (m - 1) * least((0.8::DOUBLE - (1 - share)) / share, 1.0::DOUBLE) AS pos FROM k),
 r AS (SELECT abs(tone) AS v, row_number() OVER (ORDER BY abs(tone)) - 1 AS i FROM c WHERE a),
 band AS (SELECT CASE WHEN max(gap) <= 0 THEN 0.0::DOUBLE ELSE max(CASE WHEN i = floor(pos) THEN v END) + (max(pos) - floor(max(pos))) * (max(CASE WHEN i = ceil(pos) THEN v END) - max(CASE WHEN i = floor(pos) THEN v END)) END AS band FROM r, p)
 SELECT doc_id, a::INT AS att, (CASE WHEN a AND abs(tone) > band THEN sign(tone) ELSE 0 END)::INT AS outl FROM c, band"""


@query(_OUTLOOK)
def outlook_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    d = d.select("doc_id", text.density(F.col("text"), TOPIC).alias("s"), text.tone(F.col("text"), TOPIC, UP, DOWN, NEGATORS)["tone"].alias("tone")).persist()
    coded = agreement.code_attention(d, "s", 0.3, "att")
    return agreement.code_outlook(coded, "tone", "att", 0.8, "outl").select("doc_id", "att", "outl")


@query()
def offline_classifier(spark, sf_dir):
    from ..streaming import classify

    return classify.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", keep=["doc_id"]).drop("timestamp_utc")

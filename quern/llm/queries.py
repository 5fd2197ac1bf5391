"""The registered queries of the subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, linededup, minhash, packing, sharding, store, substring, tokencount

#: Bytes of text in a shard: small ones, so that a shard is one batch of a reader.
SHARD_BYTES = 256 << 10
#: Ids in a packed sequence.
CAPACITY = 2048


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES, columns=["doc_id"])


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.train(docs.where(~held))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rate")


def op4_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "part", "n_turns", "start", "text", spans.alias("spans"), "n_masked")


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), CAPACITY, keep_ids=False)


def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.knn(vectors, vectors.where("vec_id % 100 = 0"))


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_path(spark, "token-files")
    tokencount.write(table(spark, sf_dir, "documents"), folder, tokenizer_file())
    return tokencount.count_documents(spark, folder).select("doc_id", "n_tokens", "complete")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {
    "op1_extendible_sharding": op1_extendible_sharding,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_language_id": op3_language_id,
    "op4_perspective_rotation": op4_perspective_rotation,
    "op5_line_templates": op5_line_templates,
    "op6_difference_cover": op6_difference_cover,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_pruned_graph": op8_pruned_graph,
    "op9_separator_scan": op9_separator_scan,
    "op10_decontamination": op10_decontamination,
}

OP1_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
d AS (SELECT doc_id, n, k, substr(bits, 1, k) AS p FROM r, (SELECT unnest(range(61)) AS k)),
s AS (SELECT k, p, sum(n) AS b, count(*) AS c FROM d GROUP BY k, p)
SELECT doc_id, arg_min(p, k) AS shard, arg_min(b, k)::BIGINT AS shard_bytes, arg_min(c, k)::BIGINT AS shard_rows, arg_min(b, k) > {SHARD_BYTES} AS oversize
FROM d JOIN s USING (k, p) WHERE b <= {SHARD_BYTES} OR c = 1 GROUP BY doc_id
"""

OP4_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS txt FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, txt) - 1 AS k FROM t),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
x AS (SELECT o.*, p.perspective, k // {chat.PART_TURNS} AS part, '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (SELECT *, sum(length(head) + length(txt) + 11) OVER (PARTITION BY conv_id, perspective, part ORDER BY k ROWS UNBOUNDED PRECEDING) AS fin FROM x),
z AS (SELECT conv_id, perspective, part, count(*)::INT AS n_turns, string_agg(head || txt || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
 coalesce(string_agg((fin - length(txt) - 11)::BIGINT::VARCHAR || '-' || (fin - 1)::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (speaker = perspective), '') AS spans,
 sum(CASE WHEN speaker = perspective THEN length(txt) + 10 ELSE 0 END)::BIGINT AS n_masked FROM y GROUP BY 1, 2, 3)
SELECT conv_id, perspective, part::INT AS part, n_turns, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, perspective ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, text, spans, n_masked FROM z
"""

OP6_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM w WHERE len(w) > 12)),
least_ AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
dup AS (SELECT doc_id, i FROM win JOIN least_ USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM dup, (SELECT unnest(range(13)) AS j)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) AS t, count(*) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP10_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH it AS (SELECT item_id::VARCHAR AS item, {_OP10_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT item, w, least(8, len(w)) AS n, unnest(range(len(w) - least(8, len(w)) + 1)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, {_OP10_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item, dw.n, i FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_extendible_sharding": OP1_SQL,
    "op4_perspective_rotation": OP4_SQL,
    "op5_line_templates": linededup.oracle(),
    "op6_difference_cover": OP6_SQL,
    "op10_decontamination": OP10_SQL,
}

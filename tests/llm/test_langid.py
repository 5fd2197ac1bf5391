import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, queries

from .samples import awkward, docs


def parsed(text, training):
    """Phrases by brute force, blocks and all."""
    n = 0
    for at in range(0, len(text), langid.BLOCK):
        part = text[at : at + langid.BLOCK]
        i = 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in training and part[i:j] in training:
                j += 1
            i, n = j, n + 1
    return n


@pytest.mark.parametrize("seed", range(5))
def test_phrases_equal_brute_force(seed):
    rng = random.Random(seed)
    training = {k: bytes(rng.choice(b"abc d") for _ in range(300)) for k in ("p", "q")}
    model = langid.fit(training)
    texts = ["".join(rng.choice("abcdz  ") for _ in range(n)) for n in (1, 3, 50, 511, 512, 513, 1500, 0)]
    data, offsets = langid.normalised(pa.array(texts))
    got = langid.phrases(data, offsets, model)
    for i in range(len(texts)):
        own = data[offsets[i] : offsets[i + 1]].tobytes()
        assert got[i].tolist() == [parsed(own, training[k]) for k in ("p", "q")]


def test_automaton_accepts_substrings_only():
    step = langid.automaton(b"abcbc")
    def accepts(w):
        s = 0
        for c in w:
            if c not in step[s]:
                return False
            s = step[s][c]
        return True
    words = {bytes(w) for n in range(1, 5) for w in __import__("itertools").product(b"abc", repeat=n)}
    assert all(accepts(w) == (w in b"abcbc") for w in words)


def test_normalised():
    data, offsets = langid.normalised(pa.array(["  Ab1 c!!", None, "", "é\n\nX"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])] == ["ab c ", "", "", "é x"]


def test_awkward_rows(spark):
    texts = awkward()
    source = docs(spark, texts)
    model = langid.fit({"en": b"the of was shing edor ", "fr": "le élan la de ".encode()})
    out = {r["doc_id"]: r for r in langid.identify(source, model).collect()}
    assert len(out) == len(texts) and set(source.columns) < set(out[0].asDict())
    for i, t in enumerate(texts):
        assert (out[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= out[i]["score"] <= 1
    empty = langid.train(source.where("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(source, empty).collect()} == {"und"}
    assert langid.identify(source.limit(0), model).collect() == []


def test_sample_and_prediction_by_brute_force(spark):
    """Training text, ties and scores of the query, from the documents' own rows."""
    d = "/root/testdata/sf0.001"
    rows = queries.table(spark, d, "documents").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))).collect()
    fold = lambda t: re.sub(b" +", b" ", bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in (t or "").encode().lower())).lstrip()
    training = {}
    for lang in sorted({r["lang"] for r in rows if r["lang"]}):
        own = sorted((r["h"], str(r["doc_id"]), r["text"]) for r in rows if r["lang"] == lang and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and any(map(str.isalpha, r["text"] or "")))[: langid.TRAIN_DOCS]
        share = -(-langid.TRAIN_BYTES // langid.TRAIN_DOCS)
        texts = [fold(t[: 16 * share]) for _, _, t in own]
        sizes, left, todo = {}, langid.TRAIN_BYTES, len(texts)
        for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
            sizes[i] = min(len(texts[i]), left // todo)
            left, todo = left - sizes[i], todo - 1
        training[lang] = b"".join(texts[i][: sizes[i]] for i in range(len(texts)))
    got = {r["doc_id"]: r for r in queries.op3_language_id(spark, d).collect()}
    for r in random.Random(1).sample(rows, 60):
        need = sorted((parsed(fold(r["text"]), training[k]), k) for k in training)
        assert got[r["doc_id"]]["lang_pred"] == need[0][1]
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - need[0][0] / need[1][0])


def test_short_clean_texts_are_not_strange(spark):
    d = "/root/testdata/sf0.01"
    table = queries.table(spark, d, "documents")
    model = langid.train(table)
    words = {w for r in table.select("text").limit(400).collect() for w in re.findall(r"[^\W\d_]+[.,]?", r["text"] or "")}
    texts = [*sorted(words), "a", "I", "OK.", "Yes", "Да", "PDF"]
    rows = langid.identify(docs(spark, texts), model).collect()
    assert not any(r["strange"] for r in rows) and not any(r["lang_pred"] == "und" for r in rows)
    assert all(r["strange"] for r in langid.identify(docs(spark, ["漢字の本" * 30, "ΩβγδΨ" * 50]), model).collect())


def test_clashing_names(spark):
    source = spark.createDataFrame([(1, "the of", 0.25, 7, "zz", "r")], "doc_id long, text string, score double, rate int, Lang_Pred string, row string")
    out = langid.identify(source, langid.fit({"en": b"the of was "}))
    assert out.columns == [*source.columns, "lang_pred_", "score_", "rate_", "strange"]
    assert tuple(out.first())[:6] == tuple(source.first())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in queries.table(spark, d, "documents").collect()}
    out = queries.op3_language_id(spark, d).collect()
    assert len(out) == len(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.97

import hashlib
import random
import re

import pytest

from quern.llm import queries, substring

from .samples import awkward, docs, prose


def brute(rows):
    """rows: (doc_id, text), whose ids may repeat."""
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in cut:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), kept))
    return sorted(out)


def test_cover():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring.COVER and (j + d) % 7 in substring.COVER for d in range(7))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("batch", [3, 10000])
def test_equals_brute_force(spark, seed, batch):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (12, 13, 14, 30)]
    texts = awkward(seed, 15)
    for _ in range(25):
        parts = [rng.choice([prose(rng, rng.randint(0, 9)), rng.choice(passages), "x " * 20, "x " * 5]) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    rng.shuffle(texts)
    source = docs(spark, texts)
    source = source.union(source.where("doc_id % 9 = 4"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.remove(source).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got) == brute([(r["doc_id"], r["text"]) for r in source.collect()])


@pytest.mark.parametrize("tail", [80, 5, 0])
def test_one_id_with_several_texts(spark, tail):
    """Longer, shorter and equal texts of one id: each row loses its own words only."""
    rng = random.Random(tail)
    shared, own = prose(rng, 60), " ".join(f"u{k}" for k in range(80))
    rows = [(1, shared), (5, shared + " tail of it"), (5, own[: 6 * tail]), (5, own), (5, shared), (5, shared), (2, own), (None, shared), (None, "x"), (7, None)]
    rows += [(5, prose(rng, 30)) for _ in range(10)] + [(9, shared[:200] + " " + own)] * 2
    source = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substring.remove(source).select("doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(r for r in got if r[0] is not None) == brute([r for r in rows if r[0] is not None])
    assert sorted(r[1:] for r in got if r[0] is None) == [(1, 0, "x"), (60, 0, shared)]


def test_empty(spark):
    assert substring.remove(docs(spark, ["x"]).limit(0)).collect() == []


def test_query(spark, small):
    rows = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute([tuple(r) for r in rows])]
    got = sorted(tuple(r) for r in queries.op6_difference_cover(spark, small).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == want and any(r[2] for r in got)

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import minhash, queries

from .samples import awkward, docs


def bag(t):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    bags = {i: bag(t) for i, t in rows}
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bags)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bags[i] and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def varied(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_agreement_is_similarity():
    rng = random.Random(1)
    for sizes in ((40, 4), (400, 30), (3000, 100), (6, 1)):
        a = varied(rng, sizes[0]) + " same same same same same same same same same"
        texts = pa.array([a, edited(rng, a, sizes[1])])
        words = minhash.scan(texts)
        text, h = minhash.shingles(words, words.hashes())
        cells = minhash.textscan.mix(h + minhash.counted(text, h).astype(np.uint64) * np.uint64(0x589965CC75374CC3))
        sig = minhash.signatures(text, cells, 2, 4000)
        want = jaccard(bag(texts[0].as_py()), bag(texts[1].as_py()))
        assert abs((sig[0] == sig[1]).mean() - want) < 0.04
        assert minhash.similarity(texts.slice(0, 1), texts.slice(1, 1))[0] == pytest.approx(want)


def test_similarity_rows():
    rng = random.Random(3)
    a = [varied(rng, n) for n in (3, 5, 30, 0)] + [None, "x y z"]
    b = [a[0], edited(rng, a[1], 1), edited(rng, a[2], 2), "", None, "x y"]
    got = minhash.similarity(pa.array(a), pa.array(b))
    assert got.tolist() == pytest.approx([jaccard(bag(x), bag(y)) for x, y in zip(a, b)])


@pytest.mark.parametrize("seed", range(3))
def test_classes(spark, seed):
    rng = random.Random(seed)
    texts = awkward(seed, 10)
    for _ in range(6):
        base = varied(rng, rng.choice([3, 8, 60, 400]))
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 1, 2, 3, 6])) for _ in range(6)]
    chain = [varied(rng, 120)]
    for _ in range(6):  # each close to the next, the ends far apart
        chain.append(edited(rng, chain[-1], 2))
    texts += chain + [texts[5].upper()]
    rng.shuffle(texts)
    source = docs(spark, texts)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(source.union(source.limit(3))).collect()}
    assert got == brute(list(enumerate(texts)))


def test_links_between_members_of_a_bucket(spark):
    """The least member shares bands with the others, but only the others are linked."""
    rng = random.Random(11)
    base = varied(rng, 200)
    middle = edited(rng, base, 9)
    texts = [base] + [edited(rng, middle, 1) for _ in range(12)]
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs(spark, texts), rows=1).collect()} == brute(list(enumerate(texts)))


def test_one_id_with_several_texts(spark):
    """A document is near what one of its texts is near to, and no text is lost or taken for another."""
    rng = random.Random(21)
    a, b, c, d = (varied(rng, 100) for _ in range(4))
    rows = [(1, edited(rng, a, 1)), (7, a), (7, b), (3, edited(rng, b, 1)), (7, b), (9, c), (9, d), (4, edited(rng, d, 1)), (11, None), (11, varied(rng, 50)), (None, a), (12, ""), (12, None)]
    rows += [(20 + k, edited(rng, c, 1)) for k in range(4)]
    want = {1: 1, 7: 1, 3: 1, 9: 4, 4: 4, 11: 11, 12: 12, **{20 + k: 4 for k in range(4)}}
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        assert {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()} == want


def test_deduplicated_rows(spark):
    """Distinct texts of one id both stay; equal rows stay once; clashing names come back as they were."""
    rng = random.Random(22)
    a, b, c = (varied(rng, 100) for _ in range(3))
    rows = [(7, a, "x"), (7, b, "x"), (8, edited(rng, a, 1), "x"), (7, a, "y"), (9, c, "x"), (9, c, "x"), (5, None, "x"), (5, None, "x"), (6, "", "x"), (None, a, "x"), (None, a, "x")]
    named = [(*r, 1, 2, True, "k", 3.5) for r in rows]
    source = spark.createDataFrame(named, "doc_id long, text string, variant string, node int, n int, gone boolean, key string, row double")
    out = minhash.deduplicated(source.repartition(3))
    assert out.columns == source.columns
    got = [tuple(r) for r in out.collect()]
    assert all(r in named for r in got)
    assert sorted((str(r[0]), str(r[1])) for r in got) == sorted((str(i), str(t)) for i, t in [(7, a), (7, b), (9, c), (5, None), (6, ""), (None, a), (None, a)])
    assert minhash.deduplicated(source.limit(0)).collect() == []


def test_bucket_of_members_far_from_each_other(spark, monkeypatch):
    """Many texts of one bucket, hardly any two of them linked, over several blocks: no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    base = varied(rng, 300)
    texts = [edited(rng, base, rng.choice([8, 9, 10, 11])) for _ in range(90)]
    texts += [edited(rng, texts[k], 3) for k in range(0, 60, 6)]
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs(spark, texts)).collect()} == brute(list(enumerate(texts)))


def written(spark):
    """Bytes that this session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    each = sc.statusStore().executorList(True)
    return sum(each.apply(k).totalShuffleWrite() for k in range(each.size()))


def test_signatures_stay_where_they_are(spark):
    """In a table too large to be broadcast, a text without neighbours moves its bands, and neither its sketch nor its words."""
    rng = random.Random(31)
    texts = [varied(rng, 100) for _ in range(1500)]
    texts += [edited(rng, texts[k], 1) for k in range(5)]
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        before = written(spark)
        got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs(spark, texts)).collect()}
        each = (written(spark) - before) / len(texts)
    finally:
        spark.conf.unset(key)
    assert got == {k: k if k < 1500 else k - 1500 for k in range(len(texts))}
    assert each < 1200, each


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", most)
    rng = random.Random(41)
    base = varied(rng, 100)
    texts = [base, base.upper(), "", None] + [edited(rng, base, rng.choice([1, 2, 9])) for _ in range(8)] + [varied(rng, 60) for _ in range(8)]
    source = docs(spark, texts)
    got = minhash.classes(source.union(source.limit(6)).repartition(3)).collect()
    assert len(got) == len(texts) and {r["doc_id"]: r["class_id"] for r in got} == brute(list(enumerate(texts)))


def test_empty(spark):
    assert minhash.classes(docs(spark, ["x"]).limit(0)).collect() == []
    assert [tuple(r) for r in minhash.classes(docs(spark, ["a b c d e f"])).collect()] == [(0, 0)]


def test_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_dart_minhash(spark, small).collect()}
    assert got == brute(rows) and len(set(got.values())) < len(got)

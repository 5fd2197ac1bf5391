import hashlib
import random
import re

from quern.llm import decontam, queries

from .samples import awkward, docs, prose


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items, size, threshold=2):
    windows = {}
    for name, t in items:
        w = tokens(t)
        if name is None or not w:
            continue
        n = min(size, len(w))
        for i in range(len(w) - n + 1):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for i, t in enumerate(texts):
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= threshold))
    return out


def sample():
    rng, texts = random.Random(5), awkward(1)
    items = [(i, prose(rng, 14)) for i in range(8)] + [(3, "the of"), (10, None), (None, "the of was"), (11, ""), (12, "Буква, 漢字!"), (2, prose(rng, 9)), (100, "edor")]
    texts += [prose(rng, 9) + " -- " + items[2][1].upper().replace(" ", ", ") + " " + items[5][1], items[0][1], items[0][1][3:]]
    return texts, items


def test_equals_brute_force(spark):
    texts, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.digest(decontam.hits(docs(spark, texts), bench)).orderBy("doc_id").collect()]
    assert got == brute(texts, items, 8)


def test_blocks_of_items(spark):
    texts, items = sample()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.hits(docs(spark, texts), bench, block_words=20)
    assert [tuple(r) for r in decontam.digest(found).orderBy("doc_id").collect()] == brute(texts, items, 8)


def test_long_items_and_repetitive_texts(spark):
    """Items without spaces count by their words and are cut; many windows of one rarest word propose bounded starts."""
    rng = random.Random(8)
    digits = lambda n: "\n".join(rng.choice("01") for _ in range(n))
    items = [(1, digits(300)), (2, "-".join(rng.choice("01") for _ in range(40))), (3, "0 1 0"), (4, digits(9)), (2, prose(rng, 30).replace(" ", "\t"))]
    texts = [digits(2000), "0 1 " * 300, "1", None, digits(30) + " x " + digits(30), prose(rng, 50), items[4][1] + " 0"] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items, 8)
    for most in (decontam.BLOCK_WORDS, 60):
        assert [tuple(r) for r in decontam.digest(decontam.hits(docs(spark, texts), bench, block_words=most)).orderBy("doc_id").collect()] == want
    assert max(len(b) for b in [list(decontam.parts(t, 8, 50)) for _, t in items]) > 1
    assert all(n <= 50 for _, t in items for _, n in decontam.parts(t, 8, 50))


def test_one_id_with_several_texts(spark):
    texts, items = sample()
    rows = [(k % 3 if k % 5 else None, t) for k, t in enumerate(texts)]
    source, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(i), *b[1:]) for (i, _), b in zip(rows, brute(texts, items, 8), strict=True))
    for most in (20, decontam.BLOCK_WORDS):
        assert sorted((str(r[0]), *r[1:]) for r in decontam.digest(decontam.hits(source, bench, block_words=most)).collect()) == want


def test_clean_keeps_columns(spark):
    texts, items = sample()
    source = docs(spark, texts)
    kept = decontam.clean(source, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == source.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [r[0] for r in brute(texts, items, 8) if not r[3]]


def to_and_from_workers(spark, first):
    """Bytes that Python workers got and gave in the SQL executions from the ``first`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    told, sums = spark._jsparkSession.sharedState().statusStore(), [0, 0]
    each = told.executionsList()
    for k in range(first, each.size()):
        e = each.apply(k)
        values, metrics = told.executionMetrics(e.executionId()), e.metrics()
        for m in {metrics.apply(i).accumulatorId(): metrics.apply(i) for i in range(metrics.size())}.values():
            side = ["data sent to Python workers", "data returned from Python workers"]
            if m.name() in side and values.contains(m.accumulatorId()):
                n, unit = re.search(r"([\d.]+) ([KM]?i?B)", values.apply(m.accumulatorId()).split("\n")[-1]).groups()
                sums[side.index(m.name())] += float(n) * {"B": 1, "K": 1 << 10, "M": 1 << 20}[unit[0]]
    return sums


def test_clean_moves_texts_once_a_pass(spark):
    """Workers get each text once to count words and once to match, and give no document back."""
    rng = random.Random(9)
    texts = [prose(rng, 300) for _ in range(400)]
    source = docs(spark, texts)
    items = [(0, " ".join(texts[3].split()[5:20])), (1, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    first = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    kept = sorted(r["doc_id"] for r in decontam.clean(source, bench).collect())
    sent, got = (x / sum(map(len, texts)) for x in to_and_from_workers(spark, first))
    assert kept == [b[0] for b in brute(texts, items, 8) if not b[3]] and len(kept) < 400
    assert 1.9 < sent < 2.3 and got < 0.5, (sent, got)


def test_clean_by_blocks_and_joins(spark, monkeypatch):
    texts, items = sample()
    rows = [(k % 3 if k % 5 else None, t, k) for k, t in enumerate(texts)] * 2
    source = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 2):
        want = sorted(k for (_, _, k), b in zip(rows, brute(texts, items, 8) * 2, strict=True) if b[3] < n)
        for words, most in ((decontam.BLOCK_WORDS, 1 << 20), (20, 0)):
            monkeypatch.setattr(decontam, "BLOCK_WORDS", words)
            monkeypatch.setattr("quern.llm.minhash.BROADCAST_ROWS", most)
            assert sorted(r["a.b"] for r in decontam.clean(source, bench, threshold=n).collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_items"] for r in decontam.digest(decontam.hits(docs(spark, ["a b", None]), none)).collect()} == {0}
    assert decontam.hits(docs(spark, ["a"]).limit(0), none).collect() == []


def test_query(spark, small):
    items = [tuple(r) for r in queries.table(spark, small, "benchmark").select("item_id", "text").collect()]
    rows = queries.table(spark, small, "documents").orderBy("doc_id").collect()
    want = [(r["doc_id"], *b[1:]) for r, b in zip(rows, brute([r["text"] for r in rows], items, 8), strict=True)]
    got = [tuple(r) for r in queries.op10_decontamination(spark, small).orderBy("doc_id").collect()]
    assert got == want and any(r[2] for r in got)

import random

import corpus_pipeline
from quern.llm import queries

from .samples import docs, prose
from .test_decontam import brute as contaminated
from .test_linededup import brute as lines
from .test_minhash import brute as classes


def test_stages_equal_brute_force(spark, small):
    source = queries.table(spark, small, "documents")
    d = source
    rows = {r["doc_id"]: r["text"] for r in d.collect()}
    d = corpus_pipeline.language(spark, d, small).cache()
    assert d.columns == source.columns
    assert {r["doc_id"] for r in d.collect()} == set(rows)  # all have letters
    kept = list(rows)
    want = lines([rows[i] for i in kept], 10)
    d2 = corpus_pipeline.lines(spark, d, small).cache()
    got = {r["doc_id"]: r["text"] for r in d2.collect()}
    assert got == {kept[k]: t for k, (t, _, gone) in want.items() if not gone or t.strip()}
    d3 = corpus_pipeline.near_duplicates(spark, d2, small).cache()
    named = classes(list(got.items()))
    assert sorted(r["doc_id"] for r in d3.collect()) == sorted(i for i, c in named.items() if i == c)
    d4 = corpus_pipeline.decontamination(spark, d3, small).cache()
    items = [tuple(r) for r in queries.table(spark, small, "benchmark").select("item_id", "text").collect()]
    own = [(r["doc_id"], r["text"]) for r in d3.collect()]
    clean = {own[b[0]][0] for b in contaminated([t for _, t in own], items, 8) if not b[3]}
    assert {r["doc_id"] for r in d4.collect()} == clean and d4.columns == source.columns
    packed = corpus_pipeline.packing_stage(spark, d4, small).collect()
    assert {r["doc_id"] for r in packed} == clean


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).collect()
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert out and all(sum(n for _, n in own) <= 2048 for own in used.values())


def test_awkward_rows(spark, small):
    texts = [None, "", "123 !!", "The and of is.", "The and of is.", "漢字 の 本 " * 30]
    source = docs(spark, texts)
    source = source.union(source.where("doc_id = 3")).union(spark.createDataFrame([(None, "the of and in is", "en", "s", 1, "x", "y")], source.schema))
    d = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, small).cache()
        assert d.columns == source.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in d.collect())
    assert ids == [(False, 3), (True, 0)]
    assert corpus_pipeline.packing_stage(spark, d, small).count() == 2


def test_clashing_names_and_repeated_ids(spark, small):
    """Users' columns come back unchanged; texts that only share an id all stay; short clean texts stay."""
    more = "score double, rate double, lang_pred string, strange boolean, n_lines int, n_dropped int, _gone int, shard string, _id int, row string, variant int, node int, class int, key string, spans string, `a.b` int"
    values = (0.25, 0.5, "zz", True, 7, 7, 1, "s", 5, "r", 3, 4, 9, "k", "sp", 2)
    texts = [(7, "The and of is thanwh."), (7, "Shing edor was the one."), (8, "A."), (9, "I"), (10, "Yes"), (11, "OK.")]
    texts += [(20 + k, prose(random.Random(k), 40) + " The quick brown fox jumps over my lazy dog, says Zoe." + str(k)) for k in range(9)]
    source = spark.createDataFrame([(i, t, "en", "s", 1, *values) for i, t in texts], f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    d = source
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, small)
        assert d.columns == source.columns
        d = d.cache()
    assert sorted(tuple(r) for r in d.collect()) == sorted(tuple(r) for r in source.collect())
    assert corpus_pipeline.packing_stage(spark, d, small).count() == len(texts)

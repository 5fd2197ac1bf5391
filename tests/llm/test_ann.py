import math

import numpy as np
import pytest

from quern.llm import ann, queries


def brute(ids, vectors, asked, k=10):
    """For each asked row: (score, id) of its k nearest."""
    v = np.asarray(vectors, np.float64)
    out = {}
    for i in asked:
        d = np.sqrt(((v - v[i]) ** 2).sum(1))
        out[ids[i]] = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q, w in want.items():
        own = sorted(got.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(w) + 1))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for _, v in w})
        total += len(w)
    return hits / total


def frame(spark, ids, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int, score int")


def test_recall_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    source = frame(spark, range(3000), v)
    rows = ann.knn(source, source.where("vec_id % 50 = 0"), shard_rows=700, query_block=25).collect()
    want = brute(list(range(3000)), v, range(0, 3000, 50))
    assert recall(rows, want) > 0.97
    exact = {(q, i): s for q, own in want.items() for s, i in own}
    assert all(r["score"] == pytest.approx(exact[r["query_id"], r["vec_id"]], abs=1e-12) for r in rows if (r["query_id"], r["vec_id"]) in exact)


def test_hot_vector_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = [x.tolist() for x in rng.normal(size=(60, 4)).astype(np.float32)]
    v[20:50] = [v[3]] * 30
    odd = [None, [0.0] * 4, [1.0, None, 2.0, 3.0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1.0, 2.0], [3.0, 4.0]]
    source = frame(spark, range(67), v + odd)
    rows = ann.knn(source.union(source.limit(5)), source).collect()
    assert recall([r for r in rows if r["query_id"] < 60], brute(list(range(60)), v, range(60))) == 1.0
    others = {(r["query_id"], r["vec_id"]) for r in rows if r["query_id"] >= 60}
    assert others == {(65, 66), (66, 65)}


def test_doubles(spark):
    """Vectors that single precision can't tell, or can't hold, are scored exactly; an id with several vectors counts at its nearest."""
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.normal(size=(40, 3))]
    v[1] = [x + 1e-9 for x in v[0]]
    v += [[1e39, 1e39, 0.0], [1e39, 2e39, 0.0], [1e300, 1.0, 0.0], [1e-200, 0.0, 0.0], [3e-200, 0.0, 0.0], [0.0, -0.0, 0.0]]
    rows = [(i, x) for i, x in enumerate(v)] + [(7, v[3]), (7, v[7]), (45, [0.0, 0.0, 0.0])]
    source = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.knn(source, source, shard_rows=30, query_block=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    live = [(i, x) for i, x in rows if any(x)]
    for i in {i for i, _ in live}:
        best = {}
        for a, x in live:
            for b, y in live:
                if a == i and b != i:
                    best[b] = min(best.get(b, np.inf), math.dist(x, y))
        want = sorted((d, b) for b, d in best.items())[:10]
        own = sorted(got[i])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [s for _, _, s in own] == pytest.approx([d for d, _ in want], rel=1e-12)
        assert [b for _, b, _ in own] == [b for _, b in want] or len(set(d for d, _ in want)) < 10


def test_few_and_none(spark):
    source = frame(spark, [5, 9, 10], [[1, 0], [0, 1], [2, 0]])
    assert [tuple(r)[:3] for r in ann.knn(source, source.where("vec_id = 5")).orderBy("rank").collect()] == [(5, 1, 10), (5, 2, 9)]
    assert ann.knn(source.limit(0), source).collect() == []
    assert ann.knn(source, source.limit(0)).collect() == []


def test_prune_keeps_diverse_edges():
    v = np.array([[0, 0], [0.9, 0], [1.1, 0], [0, 1], [-5, 0]], np.float32)
    assert ann.prune(v, np.array([0]), np.array([[4, 3, 2, 1, 0, -1]]), 3).tolist() == [[1, 3, 4]]


def test_query_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.table(spark, d, "embeddings").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in rows]
    want = brute(ids, [r["embedding"] for r in rows], [i for i, x in enumerate(ids) if x % 100 == 0])
    assert recall(queries.op8_pruned_graph(spark, d).collect(), want) >= 0.95

import hashlib

import pytest

from quern.llm import queries, sharding

from .samples import awkward, docs


def brute(rows, limit):
    """rows: (key, bytes), keys distinct. Splits one bucket at a time."""
    bits = {k: bin(int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16))[2:].zfill(60) for k, _ in rows}
    todo, out = [("", rows)], {}
    while todo:
        path, own = todo.pop()
        if sum(n for _, n in own) <= limit or len(own) == 1:
            out |= {k: (path, sum(n for _, n in own), len(own)) for k, _ in own}
        else:
            todo += [(path + b, [r for r in own if bits[r[0]][len(path)] == b]) for b in "01"]
    return out


@pytest.mark.parametrize("limit", [50, 400, 3000, 10**6])
def test_equals_splitting_one_by_one(spark, limit):
    texts = awkward()
    want = brute([(str(i), len((t or "").encode())) for i, t in enumerate(texts)], limit)
    source = docs(spark, texts)
    got = sharding.assign(source, limit)
    assert got.columns[: len(source.columns)] == source.columns
    rows = got.collect()
    assert {str(r["doc_id"]): (r["shard"], r["shard_bytes"], r["shard_rows"]) for r in rows} == want
    assert all(r["oversize"] == (r["shard_bytes"] > limit) for r in rows)


def test_one_key_holds_all(spark):
    source = spark.createDataFrame([(None if i % 3 else 7, "x" * 10) for i in range(300)], "doc_id long, text string")
    rows = sharding.assign(source, 55).collect()
    assert len(rows) == 300
    shards = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert all(len(v) <= 5 and v[0]["shard_bytes"] == 10 * len(v) for v in shards.values())


@pytest.mark.parametrize("broadcast_cells", [0, sharding.BROADCAST_CELLS])
def test_clashing_names_and_lookups(spark, broadcast_cells):
    texts = awkward()
    more = "shard string, Shard_Bytes int, key int, id string, path string, n int, own int, cell int, lshard_rows int"
    source = docs(spark, texts).selectExpr("*", "'s' shard", "7 Shard_Bytes", "1 key", "'i' id", "'p' path", "2 n", "3 own", "4 cell", "5 lshard_rows")
    out = sharding.assign(source, 400, broadcast_cells=broadcast_cells)
    assert more.count(",") + 1 == 9 and out.columns == [*source.columns, "shard_", "shard_bytes_", "shard_rows", "oversize"]
    rows = out.collect()
    assert sorted(map(str, (tuple(r)[: len(source.columns)] for r in rows))) == sorted(map(str, map(tuple, source.collect())))
    want = brute([(str(i), len((t or "").encode())) for i, t in enumerate(texts)], 400)
    assert {str(r["doc_id"]): (r["shard_"], r["shard_bytes_"], r["shard_rows"]) for r in rows} == want


def test_empty(spark):
    assert sharding.assign(docs(spark, ["x"]).limit(0), 10).collect() == []


def test_query(spark, small):
    rows = queries.op1_extendible_sharding(spark, small).collect()
    assert len(rows) == queries.table(spark, small, "documents").count() and all(r["shard_bytes"] <= queries.SHARD_BYTES for r in rows)

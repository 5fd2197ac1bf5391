"""The queries that SQL can say, against their SQL."""

import pytest

from quern.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert oracle.same(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder)


@pytest.mark.parametrize("limit", [1000, 20_000, 300_000])
def test_sharding_at_other_limits(spark, monkeypatch, limit):
    sql = queries.OP1_SQL.replace(str(queries.SHARD_BYTES), str(limit))
    monkeypatch.setattr(queries, "SHARD_BYTES", limit)
    rows = oracle.same(queries.op1_extendible_sharding(spark, "/root/testdata/sf0.01"), sql, "/root/testdata/sf0.01")
    assert len({r["shard"] for r in rows}) > 1

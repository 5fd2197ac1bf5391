"""Classified rows go through workers in small pieces, as they are."""

import datetime as dt
import json
from decimal import Decimal

import pyarrow as pa
import pytest

from quern.functions import coders
from quern.streaming import classify


def _fails_on_odd(prompt):
    if len(prompt) % 2:
        raise ValueError("x" * 2000)
    return json.dumps(dict.fromkeys(coders.VARIABLES, 0))


def test_pieces_are_small_and_whole():
    texts = [None, "", *("é" * (i % 5000) for i in range(9000)), "z" * (3 * classify.PIECE), "end"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    assert batch.nbytes > 15 * classify.PIECE
    pieces = list(classify._pieces(iter([batch, batch.slice(0, 0), batch.slice(5, 3)])))
    assert pa.Table.from_batches(pieces).equals(pa.Table.from_batches([batch, batch.slice(5, 3)]))
    assert max(len(p) for p in pieces) <= len(batch) // 15


@pytest.mark.parametrize("keep", [None, ["t", "id"], []])
def test_columns_come_back_as_they_went(spark, keep):
    kinds = "id bigint, prompt string, t timestamp, d date, m decimal(20,3), b binary, l array<struct<x:int,y:map<string,double>>>, `n o` int"
    rows = [(i, None if i == 3 else "p" * i, dt.datetime(2020, 3, 29, 1, 30, i), dt.date(1900, 1, 1), Decimal("1.500"), b"\x00\xff", [(None, {"k": 0.5})], None if i % 2 else 2**31 - 1) for i in range(40)]
    df = spark.createDataFrame(rows, kinds).coalesce(1)
    out = classify.classify(df, "prompt", _fails_on_odd, classify.Retry(tries=1), keep=keep)
    kept = [c for c in df.columns if keep is None or c in keep]
    assert out.columns == [*kept, *coders.VARIABLES, "error_type", "error_message", "timestamp_utc"]
    got, want = out.collect(), df.select(*kept).collect()
    assert [tuple(r[c] for c in kept) for r in got] == [tuple(r) for r in want]
    for i, r in enumerate(got):
        failed = i % 2 == 1 and i != 3  # a null is an empty prompt
        assert (r["error_type"], r["error_message"]) == (("ValueError", "x" * 1000) if failed else (None, None))
        assert [r[v] for v in coders.VARIABLES] == [None if failed else 0] * 6


def test_texts_stay_in_the_workers_where_not_asked_for(spark, small):
    from quern.plans import catalogue

    for name in ("offline_classifier", "classified"):
        plan = catalogue.QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        names = [a.name() for a in (plan.output().apply(i) for i in range(plan.output().size()))]
        assert names == ["doc_id", *coders.VARIABLES, "error_type", "error_message"]

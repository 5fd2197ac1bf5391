"""Queries over all rows of their tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import coders, series
from quern.operators import agreement
from quern.plans import catalogue

from . import oracle

SMALL = "/root/testdata/sf0.001"


def test_error_overlap_has_every_order(spark):
    """The rows, gathered, are the report of the same errors."""
    from quern.plans import q_agreement

    out = catalogue.QUERIES["error_overlap"](spark, SMALL).cache()
    assert out.agg(F.max("o_orderkey")).first()[0] > 600
    ids = {(r["kind"], r["side"]): r["ids"] for r in out.groupBy("kind", "side").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), " ").alias("ids")).collect()}
    p = q_agreement.panel(spark, SMALL).withColumn("b", F.when(F.col("o_orderkey") % 13 == 0, 1 - F.col("att")).otherwise(F.col("att")))
    for r in agreement.error_overlap(p, "att", "b", "att_b", "o_orderkey").collect():
        assert {c: r[c] for c in ("only_a", "only_b", "shared")} == {c: ids.get((r["kind"], c), "") for c in ("only_a", "only_b", "shared")}


def test_error_rows_with_nulls(spark):
    rows = [(1, 1, 1, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1), (5, None, 0, 1), (6, 1, 1, None), (7, 1, 1, 1), (1, 1, 1, 0)]
    out = agreement.error_rows(spark.createDataFrame(rows, "i int, a int, b int, t int"), "a", "b", "t", "i").collect()
    assert sorted(tuple(r) for r in out) == [("FN", "only_b", 5), ("FN", "shared", 4), ("FP", "only_a", 2), ("FP", "only_b", 3), ("FP", "shared", 1)]


def test_kappa_intervals_are_of_all_rows(spark):
    folder = "/root/testdata/sf0.01"
    out = {r["variable"]: r for r in catalogue.QUERIES["kappa_bootstrap"](spark, folder).collect()}
    n = catalogue.table(spark, folder, "orders").count()
    assert {v: r["n"] for v, r in out.items()} == {"inflation_attention": n, "inflation_outlook": n}
    for r in out.values():
        assert r["kappa_low"] < r["kappa"] < r["kappa_high"] < r["kappa_low"] + 0.05
        assert r["agreement_low"] < r["agreement"] < r["agreement_high"]


def test_cells_draw_like_items():
    rng = np.random.default_rng(3)
    a = rng.integers(-1, 2, 400)
    b = np.where(rng.random(400) < 0.7, a, rng.integers(-1, 2, 400))
    cells, count = np.unique(np.stack([a, b]), axis=1, return_counts=True)
    by_cell = coders.bootstrap_kappa_cells_ci(*cells, count, [-1, 0, 1])
    assert by_cell == pytest.approx(coders.bootstrap_kappa_ci(a, b, [-1, 0, 1]), abs=0.006)
    assert by_cell == coders.bootstrap_kappa_cells_ci(*cells, count, [-1, 0, 1])
    assert all(np.isnan(coders.bootstrap_kappa_cells_ci([1], [1], [7], [0, 1])))


def test_scalar_functions_have_every_order(spark):
    folder = "/root/testdata/sf0.01"
    out = catalogue.QUERIES["scalar_functions"](spark, folder).cache()
    assert out.count() == catalogue.table(spark, folder, "orders").count() > 5001
    oracle.same(out, catalogue.ORACLES["scalar_functions"], folder)


def test_holm_has_every_customer(spark):
    folder = "/root/testdata/sf0.1"
    out = catalogue.QUERIES["holm_adjust"](spark, folder).cache()
    oracle.same(out, catalogue.ORACLES["holm_adjust"], folder)
    assert out.count() == catalogue.table(spark, folder, "customer").count()
    assert out.groupBy("k").count().agg(F.min("count")).first()[0] > 1000


@pytest.mark.parametrize("name", ["event_to_quarter", "full_outer_align", "ffill_daily", "eop_avg_quarter"])
def test_series_of_all_rows(spark, name):
    folder = "/root/testdata/sf0.1"
    got = oracle.same(catalogue.QUERIES[name](spark, folder), catalogue.ORACLES[name], folder)
    orders = catalogue.table(spark, folder, "orders").withColumn("d", F.to_date("o_orderdate")).cache()
    if name == "event_to_quarter":
        assert sum(r["target"] for r in got) == pytest.approx(orders.agg(F.sum("o_totalprice")).first()[0] / 1000)
    elif name == "full_outer_align":
        counts = {c: catalogue.table(spark, folder, t).count() for c, t in (("n_orders", "orders"), ("n_shipped", "lineitem"), ("n_events", "events"))}
        assert {c: sum(r[c] or 0 for r in got) for c in counts} == counts
    elif name == "ffill_daily":
        v = {r["d"]: r["v"] for r in got}
        days = orders.groupBy("d").agg(F.max("o_totalprice").alias("top")).collect()
        assert all(v[r["d"]] == r["top"] // 10000 * 10000 for r in days) and min(v) == min(r["d"] for r in days) and max(v) == max(r["d"] for r in days)


def test_changes_leave_gaps(spark):
    from quern.plans import q_ordered

    for scale in ("sf0.001", "sf0.1"):
        one = q_ordered._changes(spark, f"/root/testdata/{scale}").agg(F.count("*").alias("n"), F.date_diff(F.max("d"), F.min("d")).alias("days")).first()
        assert 2 < one["n"] < 0.9 * one["days"]


def test_mixed_sort_places_every_order(spark):
    folder = "/root/testdata/sf0.01"
    out = catalogue.QUERIES["mixed_sort"](spark, folder).cache()
    oracle.same(out, catalogue.ORACLES["mixed_sort"], folder)
    assert out.count() == catalogue.table(spark, folder, "orders").count() > 30


def test_block_bootstrap_has_the_default_draws(spark, monkeypatch):
    from quern.operators import inference
    from quern.plans import q_kernels

    seen = {}
    monkeypatch.setattr(inference, "correlation_rows", lambda df, by, expected=None, min_lags=0, n_draws=series.DRAWS: seen.setdefault("n", n_draws))
    q_kernels.block_bootstrap(spark, SMALL)
    assert seen == {"n": 10_000}

"""Reports of gates, and lookups next to estimates."""

import pytest

from quern.operators import inference, quality


def test_outcomes_tell_and_other_errors_pass_through(spark):
    def wrong():
        raise ZeroDivisionError

    got = quality.outcomes(spark, {"a": lambda: quality.require(True, "x"), "b": lambda: quality.require(False, "x")}).collect()
    assert [tuple(r) for r in got] == [("a", True), ("b", False)]
    assert quality.outcomes(spark, {}).collect() == []
    with pytest.raises(ZeroDivisionError):
        quality.outcomes(spark, {"c": wrong})


def test_reliability_is_looked_up(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.2), (None, 0.3)], "spec string, correlation double")
    stored = spark.createDataFrame([("a", 0.8), ("c", 0.9)], "spec string, reliability double")
    assert {(r["spec"], r["reliability"]) for r in inference.with_reliability(rows, stored, ["spec"]).collect()} == {("a", 0.8), ("b", None), (None, None)}
    with pytest.raises(quality.GateError):
        inference.with_reliability(rows, stored.union(stored), ["spec"])


def test_alternatives_stand_next_to_the_baseline(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "t int, m double, base double, other double")
    out = {r["spec"]: r for r in inference.alternative_specs(df, "t", "m", "base", ["other"]).collect()}
    r = np.corrcoef(x.T)
    assert set(out) == {"m~base", "m~other"}
    assert out["m~base"]["difference"] == 0 and out["m~base"]["same_sign"]
    assert out["m~other"]["difference"] == pytest.approx(r[0, 2] - r[0, 1])

"""Published figures come out again. Counts, and what was estimated from them."""

import pytest
from pyspark.sql import functions as F

from quern.functions import coders, series
from quern.operators import agreement, measures

#: variable: tp, fp, fn, tn, sensitivity interval, specificity interval, coded share, corrected share, its bounds.
CELLS = {
    "inflation_attention": (10, 3, 0, 17, (0.6915028921812392, 1.0), (0.6210731734546859, 0.9679290628145363), 0.5877256317689531, 0.5149713314928859, (0.33619034623924743, 0.8426262791390646)),
    "growth_attention": (16, 2, 0, 12, (0.7940927857921773, 1.0), (0.5718708390903009, 0.9822054845168084), 0.7981949458483755, 0.764560770156438, (0.6471142776354109, 1.0)),
    "financial_stability_attention": (19, 0, 0, 11, (0.8235330881930345, 1.0), (0.7150858470818455, 1.0), 0.7021660649819494, 0.7021660649819494, (0.5834990494729204, 0.8526264154396225)),
    "uncertainty_attention": (19, 0, 0, 11, (0.8235330881930345, 1.0), (0.7150858470818455, 1.0), 0.5487364620938628, 0.5487364620938628, (0.3689379537468491, 0.6663198722201676)),
}
#: coded ones and zeros, false positives and negatives, coded share; sensitivity, specificity, true share.
RECOVERED = [
    (38, 22, 10, 0, 0.5991902834008097, 1.0, 0.7176650133536817, 0.4415086298742808),
    (49, 11, 14, 0, 0.813029076186971, 1.0, 0.4459493353398545, 0.580735054419265),
    (46, 14, 14, 0, 0.7136547662863453, 1.0, 0.5686592303047637, 0.49645548959050106),
    (39, 21, 20, 0, 0.5590725064409275, 1.0, 0.6059764986641072, 0.2723686569840416),
]
P_VALUES = [0.09227659217175643, 0.02846443916961557, 0.5548491982500507, 0.018192998584627532, 0.31868553903071206]
P_HOLM = [0.2768297765152693, 0.11385775667846228, 0.6373710780614241, 0.09096499292313766, 0.6373710780614241]


@pytest.mark.parametrize("variable", CELLS)
def test_exact_intervals_and_corrected_shares(variable):
    tp, fp, fn, tn, sens, spec, share, corrected, bounds = CELLS[variable]
    assert coders.clopper_pearson_ci(tp, tp + fn) == pytest.approx(sens, abs=1e-9)
    assert coders.clopper_pearson_ci(tn, tn + fp) == pytest.approx(spec, abs=1e-9)
    assert coders.correct_share(share, tp / (tp + fn), tn / (tn + fp)) == pytest.approx(corrected, abs=1e-9)
    assert coders.corrected_share_bounds(share, sens, spec) == pytest.approx(bounds, abs=1e-9)


def test_rate_table_has_the_same_rates(spark):
    rows = [(v, a, b) for v, (tp, fp, fn, tn, *_) in CELLS.items() for a, b, n in ((1, 1, tp), (1, 0, fp), (0, 1, fn), (0, 0, tn)) for _ in range(n)]
    found = {r["variable"]: r for r in agreement.rate_table(spark.createDataFrame(rows, "variable string, a int, b int")).collect()}
    for v, (tp, fp, fn, tn, sens, spec, *_) in CELLS.items():
        r, share = found[v], (tp + fp) / (tp + fp + fn + tn)
        assert (r["n_true_one"], r["n_true_zero"], r["coded_share"]) == (tp + fn, tn + fp, pytest.approx(share))
        assert (r["sens_low"], r["sens_high"], r["spec_low"], r["spec_high"]) == pytest.approx((*sens, *spec), abs=1e-9)
        assert (r["corrected_low"], r["corrected_high"]) == pytest.approx(coders.corrected_share_bounds(share, sens, spec), abs=1e-9)


def test_rate_table_without_cases(spark):
    empty = spark.createDataFrame([], "variable string, a int, b int")
    assert agreement.rate_table(empty).collect() == []
    r = agreement.rate_table(spark.createDataFrame([("v", 1, 1), ("v", None, 0), ("v", 1, None)], "variable string, a int, b int")).first()
    assert (r["n_true_one"], r["n_true_zero"], r["sensitivity"], r["specificity"], r["corrected_low"]) == (1, 0, 1.0, None, None)


def test_recovered_rates(spark):
    df = spark.createDataFrame([(1 - fp / one, 1 - fn / zero, q) for one, zero, fp, fn, q, *_ in RECOVERED], "ppv double, npv double, q double")
    rates = measures.recovered_rates(F.col("ppv"), F.col("npv"), F.col("q"))
    got = df.select(*[rates[k].alias(k) for k in ("sensitivity", "specificity", "prevalence")]).collect()
    for r, (one, zero, fp, fn, q, *want) in zip(got, RECOVERED, strict=True):
        assert tuple(r) == pytest.approx(want, abs=1e-9)
        assert coders.recover_rates(1 - fp / one, 1 - fn / zero, q) == pytest.approx(want, abs=1e-9)


def test_pooled_interval():
    assert coders.clopper_pearson_ci(243, 300) == pytest.approx((0.7609551716428749, 0.8528025237104742), abs=1e-9)


def test_step_down_p_values():
    assert series.holm_adjust(P_VALUES) == pytest.approx(P_HOLM, abs=1e-12)

"""Operators on small awkward frames."""

import datetime as dt
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import coders, lexicon, text
from quern.operators import agreement, inference, measures, ordered, panel, quality, relational, sampling
from quern.sources import readers, sinks
from quern.streaming import classify, windows

D = dt.date


def one(spark, s, c):
    return spark.createDataFrame([(s,)], "t string").select(c).first()[0]


def python_net(sentence, terms, negators):
    total, negator = 0, lexicon.python_pattern(negators)
    for m in lexicon.python_pattern(terms).finditer(sentence):
        near = re.findall(r"\b\w+\b", sentence[: m.start()])[-3:]
        total += -1 if any(negator.fullmatch(w) for w in near) else 1
    return total


def test_net_direction_equals_python(spark):
    rng = random.Random(4)
    words = ["not", "no", "rising", "second-round", "above target", "strong", "de-anchoring", "café", "is", "longer", "été,", "Rising.", "unable", "x_y"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    terms = lexicon.DIRECTION_TERMS["inflation"]["up"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", text.net_direction(F.col("t"), terms).alias("n")).collect()}
    assert got == {i: python_net(r, terms, lexicon.NEGATORS) for i, r in enumerate(rows)}


def test_score(spark):
    t = "Inflation is not rising. Prices fell sharply! Growth is strong? Nothing here."
    r = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(*[c.alias(k) for k, c in text.score(F.col("t")).items()]).collect()
    assert r[0]["dict_n_words"] == 12 and r[0]["n_sent_inflation"] == 2 and r[0]["tone_inflation"] == -1.0 and r[0]["tone_growth"] == 1.0
    assert r[0]["dens_inflation"] == pytest.approx(2000 / 12)
    assert all(v == 0 for row in r[1:] for v in row)


def test_tokens(spark):
    for s in ("a b c", "  x  y ", "", "a\x1cb\td", "　"):
        assert one(spark, s, text.word_count(F.col("t"))) == len(s.split())
        assert one(spark, s, text.excerpt(F.col("t"), 2)) == " ".join(s.split()[:2])
        assert one(spark, s, text.is_blank(F.col("t"))) == (not s.strip())
    assert one(spark, None, text.word_count(F.col("t"))) == 0
    long = " ".join(["w"] * 2001)
    assert one(spark, long, F.size(F.split(text.excerpt(F.col("t")), " "))) == 2000


def test_section_diff():
    old, new = "# A\nx\ny\n\n# B\nz\n", "# A\nx\nw\n# C\nq\n"
    assert text.section_diff(old, new) == [("A", "modified", "y"), ("A", "modified", "w"), ("B", "removed", "z"), ("C", "added", "q")]


def test_gates(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 3.0)], "k int, v double")
    for call in (
        lambda: quality.require_unique(df, ["k"]), lambda: quality.require_between(df.na.fill(9.0), "v", 0, 5), lambda: quality.require_matched(df, "v"), lambda: quality.require_columns(df, ["k", "z"]),
        lambda: quality.require_columns(df, ["k"], exact=True), lambda: quality.require_first(df, "k", 0), lambda: quality.require_same_count(df, df.limit(1)), lambda: quality.require_names(df.select(F.col("k").cast("string").alias("n")), "n", ["1", "7"]),
        lambda: relational.join_one_to_one(df, df, ["k"]), lambda: relational.lookup(df, [2, 5], "k"),
    ):
        with pytest.raises(quality.GateError):
            call()
    quality.require_names(df.select(F.col("k").cast("string").alias("n")), "n", ["1", "2"])
    months = spark.createDataFrame([(D(2000, 1, 1),), (D(2000, 7, 1),)], "p date")
    with pytest.raises(quality.GateError):
        quality.require_gap_free(months, "p", 3)
    quality.require_gap_free(months, "p", 6)
    records = spark.createDataFrame([(0, 1), (1, -1), (2, 0)], "inflation_attention int, inflation_outlook int")
    checks = {r["check"]: r["n_wrong"] for r in quality.check_table(records, quality.record_checks(["inflation_attention"], {"inflation_outlook": "inflation_attention"})).collect()}
    assert checks == {"inflation_attention_domain": 1, "inflation_outlook_domain": 0, "inflation_outlook_needs_attention": 1}


def test_next_event_boundaries(spark):
    events = spark.createDataFrame([(D(2000, 1, 10),), (D(2000, 3, 1),), (D(2000, 3, 1),), (None,)], "e date")
    rows = spark.createDataFrame([(i, d) for i, d in enumerate([D(1999, 1, 1), D(2000, 1, 9), D(2000, 1, 10), D(2000, 2, 29), D(2000, 3, 1), None])], "i int, d date")
    got = {r["i"]: (r["event_index"], r["window_start"]) for r in relational.next_event(rows, "d", events, "e").collect()}
    assert got == {0: (0, None), 1: (0, None), 2: (1, D(2000, 1, 10)), 3: (1, D(2000, 1, 10))}


def test_range_join_equals_expression(spark):
    rng = random.Random(1)
    terms = [("a", "2000-01-01", "2000-12-31"), ("b", "2000-06-01", "2001-03-01"), ("c", "2002-01-01", None)]
    rows = spark.createDataFrame([(i, D(1999, 6, 1) + dt.timedelta(days=rng.randint(0, 1500))) for i in range(200)] + [(999, None)], "i int, d date")
    table = spark.createDataFrame([(n, a, b, k) for k, (n, a, b) in enumerate(terms)], "h string, s string, e string, k int").select("h", F.to_date("s").alias("s"), F.to_date("e").alias("e"), "k")
    a = {r["i"]: r["h"] for r in relational.office_holders(rows, "d", terms, "h").collect()}
    b = {r["i"]: r["h"] for r in relational.range_join(rows, "d", table, "s", "e", "k").collect()}
    assert a == b and set(a.values()) == {"a", "b", "c", None}


def test_ordered_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "t int, v double")
    w = ordered.over("t")
    rows = df.select("t", ordered.running_total(F.col("v"), w).alias("c"), ordered.fill_forward(F.col("v"), w).alias("f"), ordered.lead_difference(F.col("v"), 2, w).alias("d")).orderBy("t").collect()
    assert [tuple(r)[1:] for r in rows] == [(1.0, 1.0, 1.0), (None, 1.0, None), (3.0, 2.0, None)]
    events = spark.createDataFrame([(D(2000, 1, 5), 1.0, None), (D(2000, 4, 5), 2.0, 5.0), (D(2000, 10, 1), 3.0, 1.0)], "d date, a double, b double")
    with pytest.raises(quality.GateError):
        ordered.events_by_quarter(events, "d", ["a", "b"])
    full = ordered.events_by_quarter(events.unionByName(spark.createDataFrame([(D(2000, 8, 1), 1.0, 1.0)], events.schema)), "d", ["a", "b"]).orderBy("period").collect()
    assert [r["b_cumulative"] for r in full] == [None, 5.0, 6.0, 7.0]


def test_holm_equals_kernel(spark):
    from quern.functions import series

    p = [0.04, 0.01, 0.03, 0.9, 0.2]
    rows = ordered.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").orderBy("i").collect()
    assert [r["p_holm"] for r in rows] == pytest.approx(series.holm_adjust(p))
    assert inference.holm_count(spark.createDataFrame([(x,) for x in p], "p double"), "p").first()["n_rejected"] == 1


def test_measures_edge_cases(spark):
    rows = [(D(2000, 1, 1), 0, 0), (D(2000, 1, 2), 1, 1), (D(2000, 2, 1), 0, 0), (D(2000, 5, 1), 1, -1), (D(2000, 5, 2), 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "date date, inflation_attention int, inflation_outlook int")
    m = measures.aggregate(df, "month", speaker=None, words=None, topics={"pi": "inflation_attention"}, outlooks={"pi": "inflation_outlook"}, rates={"pi": (0.5, 0.5)})
    out = {r["period"]: r for r in measures.reindex_calendar(m, "month").collect()}
    assert list(sorted(out)) == ["2000-01", "2000-02", "2000-03", "2000-04", "2000-05"]
    assert out["2000-02"]["out_pi"] is None and out["2000-02"]["polar_pi"] is None and out["2000-01"]["disp_pi"] is None
    assert out["2000-03"]["n_speeches"] == 0 and out["2000-03"]["sparse"] and out["2000-03"]["att_pi"] is None
    assert out["2000-05"]["polar_pi"] == 1.0 and out["2000-05"]["disp_pi"] == pytest.approx(math.sqrt(2)) and out["2000-05"]["att_pi_corr"] == 1.0
    measures.weighted_equals_conditional(df, "inflation_attention", "inflation_outlook")
    null = spark.range(1).select(measures.corrected(F.lit(None).cast("double"), 0.9, 0.8).alias("c")).first()["c"]
    assert null is None


def test_calibration(spark):
    import numpy as np

    scores = [0.0, 0.0, 1.0, 2.0, 2.0, 3.0, 5.0]
    df = spark.createDataFrame([(s, (-1) ** i * s) for i, s in enumerate(scores)], "s double, t double")
    assert agreement.threshold_at_prevalence(df, "s", 0.3) == pytest.approx(np.quantile(scores, 0.7))
    with pytest.raises(quality.GateError):
        agreement.threshold_at_prevalence(df, "s", 1.0)
    coded = agreement.code_attention(df, "s", 0.5, "a")
    assert coded.agg(F.sum("a")).first()[0] == 2
    out = agreement.code_outlook(agreement.code_attention(df, "s", 0.9, "a"), "t", "a", 0.5, "o").collect()
    assert all(r["o"] in (-1, 0, 1) and (r["a"] or not r["o"]) for r in out)
    with pytest.raises(quality.GateError):
        agreement.code_outlook(df.withColumn("a", F.lit(0)), "t", "a", 0.5, "o")


def test_allocation_and_draw(spark):
    sizes = {"a": 5, "b": 50, "c": 45}
    out = sampling.allocate(sizes, 20, {"a": 3.0})
    assert sum(out.values()) == 20 and all(out[s] <= sizes[s] for s in sizes)
    assert sampling.allocate({"a": 1, "b": 1}, 2) == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        sampling.allocate({"a": 1}, 2)
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)], "id string, stratum string")
    first, again = ({r["id"] for r in sampling.draw(df.repartition(k), out, "id").collect()} for k in (1, 7))
    assert first == again and {s: sum(x[0] == s for x in first) for s in sizes} == out
    assert sampling.replay_draw(list("abcdef"), 3, 1) == sampling.replay_draw(list("abcdef"), 3, 1)
    with pytest.raises(quality.GateError):
        sampling.blind_sheet(df, ["id", "stratum"], ["stratum"], [])
    sheet, key = sampling.blind_sheet(df, ["id"], ["stratum"], ["code"])
    assert sheet.columns == ["id", "code"] and key.columns == ["id", "stratum"]
    picked = sampling.treated_and_controls(df, F.col("stratum") == "a", "id", 4)
    assert {r["group"]: r["count"] for r in picked.groupBy("group").count().collect()} == {"treated": 5, "control": 4}


def test_panel(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('date|speakers|title|subtitle|contents\n2001-05-01|A "x" B|T1|s|the and of text\n2001-05-01|C|T0||der die das und\n1990-01-01|C|T|s|old\nbad|C|T|s|x\n2001-06-01||T|s|  \n', encoding="utf-8")
    clean = panel.clean(readers.raw_corpus(spark, str(path)))
    ids = panel.numbered(clean, ["date", "title"], "ecb_")
    assert [(r["speech_id"], r["title"]) for r in ids.orderBy("speech_id").collect()] == [("ecb_0001", "T0"), ("ecb_0002", "T1")]
    assert panel.numbered_by_window(clean, ["date", "title"], "ecb_").count() == 2
    signals = ids.select("speech_id", F.lit(1).alias("inflation_attention"))
    out = {r["title"]: r for r in panel.build(ids, signals).collect()}
    assert out["T0"]["non_english"] and not out["T1"]["non_english"] and out["T0"]["president"] == "Willem F. Duisenberg" and out["T1"]["yq"] == "2001Q2"


def test_readers_and_sinks(spark, tmp_path):
    calls = []
    get = lambda url: calls.append(url) or b"TIME_PERIOD,OBS_VALUE\n2000-Q2,1.5\n2000-05,2\n2000,3\n2000-05-07,\n"
    p = readers.fetch("http://x", str(tmp_path / "a.csv"), get)
    assert readers.fetch("http://x", p, get) == p and calls == ["http://x"]
    got = readers.series_csv(spark, p).withColumn("d", readers.period_date()).collect()
    assert [r["d"] for r in got] == [D(2000, 4, 1), D(2000, 5, 1), D(2000, 1, 1), D(2000, 5, 7)]
    readers.register(spark)
    src = spark.read.format("series").option("url", f"file://{tmp_path}/{{series}}.csv").option("series", "a").load()
    assert src.count() == 4 and src.where("OBS_VALUE is null").count() == 1
    rates = spark.createDataFrame([("v", 0.9, 0.8)], "variable string, sensitivity double, specificity double")
    sinks.rates_json(rates, {"a": "b"}, ["c"], str(tmp_path / "r.json"))
    back = readers.error_rates(spark, str(tmp_path / "r.json")).first()
    assert (back["variable"], back["sensitivity"]) == ("v", 0.9) and readers.read_json(str(tmp_path / "r.json"))["caveats"] == ["c"]
    sinks.text_per_row(spark.createDataFrame([("n1", "body\nline")], "n string, b string"), str(tmp_path / "texts"), "n", "b")
    assert [f.read_text() for f in (tmp_path / "texts" / "name=n1").glob("part-*")] == ["body\nline\n"]
    tex = sinks.latex(rates.withColumn("s", F.lit("**")), {"variable": "V_1", "sensitivity": "S"}, "50% of", "t:x", stars="s")
    assert r"V\_1" in tex and "0.900$^{**}$" in tex and r"50\%" in tex
    assert "0.90" in sinks.report(rates, "T", 2)
    filled = spark.createDataFrame([("x", None)], "a string, b string").select(readers.template("{a}-{b}-{c}", {"a": "a", "b": "b"}).alias("t")).first()["t"]
    assert filled == "x--{c}"
    sinks.overwrite_csv(spark.createDataFrame([('q"uote', "l\nm")], "a string, b string"), str(tmp_path / "c"))
    assert readers.table_csv(spark, str(tmp_path / "c"), "a string, b string", ["b"]).first()["b"] == "l\nm"


def test_retry():
    waits, tries = [], []

    def fails(n):
        def call():
            tries.append(1)
            if len(tries) <= n:
                raise classify.Transient("busy")
            return {"ok": 1}

        return call

    assert classify.Retry().run(fails(3), waits.append) == {"ok": 1} and waits == [2, 4, 8]
    waits.clear(), tries.clear()
    with pytest.raises(classify.Transient):
        classify.LINEAR.run(fails(9), waits.append)
    assert waits == [2, 4, 6, 8]
    with pytest.raises(KeyError):
        classify.Retry().run(lambda: {}["x"], waits.append)


def test_classify_resume_and_stream(spark, tmp_path):
    def model(prompt):
        if "boom" in prompt:
            raise KeyError("boom")
        return classify.offline(prompt) if "odd" not in prompt else json.dumps({v: 5 for v in coders.VARIABLES})

    rows = spark.createDataFrame([("a", "Inflation is rising."), ("b", "boom"), ("c", "odd"), ("d", None)], "id string, prompt string")
    signals, errors = str(tmp_path / "s"), str(tmp_path / "e")
    assert classify.resume(rows, "prompt", "id", signals, errors, classifier=model) == 4
    assert classify.resume(rows, "prompt", "id", signals, errors, classifier=classify.offline) == 2
    got = {r["id"]: r for r in spark.read.parquet(signals).collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"]["inflation_outlook"] == 1
    assert {r["error_type"] for r in spark.read.parquet(errors).collect()} == {"KeyError", "ValueError"}
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = classify.stream(source, "prompt", "id", str(tmp_path / "s2"), str(tmp_path / "e2"), str(tmp_path / "cp"), classifier=classify.offline)
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "s2")).count() == 4
    for bad in ({"x": 1}, {**dict.fromkeys(coders.VARIABLES, 0), "growth_outlook": 1}, {**dict.fromkeys(coders.VARIABLES, 0), "growth_attention": True}):
        with pytest.raises(ValueError):
            classify.validate(bad)


def test_streamed_windows_equal_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = windows.windowed(source).writeStream.outputMode("complete").format("memory").queryName("w_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r["window_start"], r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("w_out")) == key(windows.windowed(events))
    assert windows.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_inference_groups(spark):
    rows = [("a", t, float(t % 7), float((t * 3) % 11)) for t in range(40)] + [("b", t, 1.0, float(t)) for t in range(40)] + [("c", 1, 1.0, 2.0)]
    out = {r["g"]: r for r in inference.correlations(spark.createDataFrame(rows, "g string, t int, x double, y double"), ["g"]).collect()}
    assert out["a"]["error"] is None and out["b"]["correlation"] is None and "constant" in out["b"]["error"] and "needed" in out["c"]["error"]
    long = spark.createDataFrame([r[1:] for r in rows[:40]], "t int, x double, y double")
    bands = inference.bandwidth_sensitivity(long, [0, 2, 5]).collect()
    assert len({round(r["correlation"], 10) for r in bands}) == 1 and len({r["standard_error"] for r in bands}) == 3
    frame = spark.createDataFrame([(1, 1.0)], "k int, v double")
    inference.require_reproduced(frame, frame, ["k"], "v")
    with pytest.raises(quality.GateError):
        inference.require_reproduced(frame, frame.withColumn("v", F.lit(2.0)), ["k"], "v")


def test_agreement_frames(spark):
    rows = [(i, i % 2 == 0, v, (i + k) % 2, (i * 7 + k) % 3 % 2) for i in range(12) for k, v in enumerate(coders.ATTENTION)]
    pairs = spark.createDataFrame(rows, "id int, cut boolean, variable string, a int, b int")
    table = {r["variable"]: r for r in agreement.with_intervals(agreement.agreement_table(pairs), pairs, 200).collect()}
    for v in coders.ATTENTION:
        a, b = zip(*[(x[3], x[4]) for x in rows if x[2] == v])
        po, k = coders.cohen_kappa(a, b, [0, 1])
        assert table[v]["agreement"] == pytest.approx(po) and table[v]["kappa"] == pytest.approx(k)
        assert table[v]["kappa_low"] <= k <= table[v]["kappa_high"]
    same = spark.createDataFrame([("v", 1, 1), ("v", 1, 1)], "variable string, a int, b int")
    assert agreement.agreement_table(same).first()["kappa"] is None
    assert agreement.restricted(pairs, "id", coders.ATTENTION, 3).count() == 0
    both = agreement.ceiling(agreement.agreement_table(pairs), agreement.agreement_table(pairs)).collect()
    assert all(r["kappa_change"] == 0 for r in both)
    flags = spark.createDataFrame([(1, 0, "agree")], "a int, b int, f string")
    with pytest.raises(quality.GateError):
        agreement.require_flags_consistent(flags, "a", "b", "f")


def test_sql_functions(spark):
    from quern.functions import series, udfs

    udfs.register(spark)
    r = spark.sql("select clopper_pearson(3, 20) as ci, t_pvalue(2.0, 10.0) as p, binomial_cdf(3, 20, 0.2) as b, sign_test(5, 5) as s").first()
    assert (r["ci"]["low"], r["ci"]["high"]) == pytest.approx(coders.clopper_pearson_ci(3, 20)) and r["p"] == pytest.approx(series.two_sided_t_pvalue(2.0, 10)) and r["s"] == 0.03125
    rows = [(1, 1), (0, 1), (1, 1), (0, 0)]
    spark.createDataFrame(rows, "a int, b int").createOrReplaceTempView("codes")
    assert spark.sql("select cohen_kappa(a, b) as k from codes").first()["k"] == pytest.approx(coders.cohen_kappa(*zip(*rows), [0, 1])[1])
    assert [tuple(x) for x in spark.sql("select * from section_diff('# A\\nx', '# A\\ny')").collect()] == [("A", "modified", "x"), ("A", "modified", "y")]


def test_audit_and_chart(spark, tmp_path):
    raw = spark.createDataFrame([(D(2000, 1, 1), "t", "one two"), (D(2000, 1, 1), "t", "one two"), (D(2002, 1, 1), "u", None)], "date date, title string, contents string")
    out = {k: [r.asDict() for r in v.collect()] for k, v in quality.corpus_audit(raw, "date", "title", "contents").items()}
    assert [r["n"] for r in sorted(out["years"], key=lambda r: r["year"])] == [2, 0, 1]
    assert {r["column"]: r["n_null"] for r in out["nulls"]} == {"date": 0, "title": 0, "contents": 1}
    assert {r["keys"]: (r["n_repeated"], r["n_involved"]) for r in out["duplicates"]} == {"all": (1, 2), "date and title": (1, 2)}
    assert quality.short_texts(spark.createDataFrame([(5, "a"), (500, "b")], "w int, id string"), "w").count() == 1
    path = tmp_path / "c.svg"
    sinks.svg_lines(spark.createDataFrame([(1, 1.0, None), (2, 3.0, 2.0), (3, None, 1.0)], "x int, a double, b double"), "x", ["a", "b"], "A & B", str(path))
    assert path.read_text().count("<path") == 2 and "A &amp; B" in path.read_text()
    counts = inference.spec_counts(spark.createDataFrame([("a", 0.01), ("a", None), ("b", 0.2)], "k string, p_value double"), ["k"])
    assert {r["k"]: (r["n_specs"], r["n_estimated"], r["n_significant"]) for r in counts.collect()} == {"a": (2, 1, 1), "b": (1, 1, 0)}

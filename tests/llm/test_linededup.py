import collections
import random
import re

import pytest

from quern.llm import linededup, queries

from .. import oracle
from .samples import awkward, docs, prose


def brute(texts, min_docs, same=linededup.SAME):
    lines = []
    for i, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.split("[ \t\r]+", line.strip(" \t\r"))]
            if t is not None and len(w) >= linededup.SHORT:
                lines.append((i, n, tuple(w), (len(w), *w[: linededup.DEPTH])))
    leaves = collections.Counter(x[3] for x in lines)
    lines = [x for x in lines if leaves[x[3]] >= min_docs]
    having = collections.defaultdict(set)
    for i, _, w, leaf in lines:
        having[leaf, w].add(i)
    tokens = collections.Counter()
    for (leaf, w), ids in having.items():
        for k, x in enumerate(w):
            tokens[leaf, k, x] += len(ids)
    named, owners = {}, collections.defaultdict(set)
    for i, n, w, leaf in lines:
        shape = tuple(x if x != "<*>" and tokens[leaf, k, x] >= min_docs else "<*>" for k, x in enumerate(w))
        if sum(tokens[leaf, k, x] >= min_docs and x != "<*>" for k, x in enumerate(w)) / len(w) < same:
            shape = w
        named[i, n] = shape
        owners[shape].add(i)
    out = {}
    for i, t in enumerate(texts):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        cut = t.split("\n")
        gone = {n for n in range(len(cut)) if (s := named.get((i, n))) and len(owners[s]) >= min_docs and min(owners[s]) != i}
        out[i] = ("\n".join(x for n, x in enumerate(cut) if n not in gone), len(cut), len(gone))
    return out


def sample(seed):
    rng = random.Random(seed)
    texts = awkward(seed, 10)
    for k in range(40):
        own = [prose(rng, rng.randint(1, 8)) for _ in range(rng.randint(0, 4))]
        own += rng.choice([[], ["All rights reserved."], [f"Copyright {1900 + k} by the shing edor company, version {k}.0"], ["user x%s logged in from the tion host" % rng.choice("abcdefgh")], ["", "Of."], [" \tAll  rights\treserved.\r"]])
        rng.shuffle(own)
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("min_docs", [2, 5])
def test_equals_brute_force(spark, seed, min_docs):
    texts = sample(seed)
    source = docs(spark, texts)
    got = linededup.drop_lines(source, min_docs, min_tokens=linededup.SHORT)
    assert got.columns == [*source.columns, "n_lines", "n_dropped"]
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()}
    assert rows == brute(texts, min_docs) and any(r[2] for r in rows.values())


def test_joined_where_too_many_to_broadcast(spark):
    texts = sample(7)
    rows = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.drop_lines(docs(spark, texts), 2, known_limit=0, min_tokens=linededup.SHORT).collect()}
    assert rows == brute(texts, 2)


def test_copies_of_a_row_over_batches(spark):
    """Repeated rows of one id, read in different batches, are one document."""
    source = spark.createDataFrame([(1, "a b c d\nown words of one"), (2, "a b c d")], "doc_id long, text string").repartition(2, "doc_id")
    many = source.union(source).union(source)
    assert linededup.drop_lines(many, 3).where("n_dropped > 0").count() == 0
    assert linededup.drop_lines(many, 2).where("n_dropped > 0").select("doc_id").distinct().collect() == [(2,)]


def test_variable_fields_share_a_template(spark):
    rng = random.Random(0)
    texts = [f"{prose(rng, 12)}\nserved by host{k} in {k * 7} ms on the main road" for k in range(9)]
    texts += [f"{prose(rng, 12)}\nleft by {w} with the very last train of that same day" for w in ("anna", "bert", "carl", "dora", "emil")]
    out = {r["doc_id"]: r["n_dropped"] for r in linededup.drop_lines(docs(spark, texts), 5).collect()}
    assert [out[i] for i in range(14)] == [0] + [1] * 8 + [0] + [1] * 4


def test_clean(spark):
    texts = ["All rights reserved."] * 6 + ["Own words stay here.\nAll rights reserved.", "", None, "Of."]
    source = docs(spark, texts)
    kept = {r["doc_id"]: r["text"] for r in linededup.clean(source, 5).collect()}
    assert kept == {0: "All rights reserved.", 6: "Own words stay here.", 7: "", 8: None, 9: "Of."}


def test_repeated_rows_and_null_ids(spark):
    source = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in linededup.drop_lines(source.where("doc_id is not null"), 2).collect())
    assert rows == [(1, "a b c d", 1, 0)] * 2 + [(2, "", 1, 1)]
    assert linededup.drop_lines(source, 3).where("n_dropped > 0").count() == 0
    assert linededup.drop_lines(source.limit(0), 2).collect() == []


@pytest.mark.parametrize("known_limit", [0, linededup.KNOWN_LINES])
def test_string_ids_and_clashing_names(spark, known_limit):
    rows = [(str(k), "a b c d", k, "x", 1.5, [k], "l") for k in range(3)] + [("odd", "a b c d", 7, "x", 1.5, [], "l"), ("2", "own words of it\na b c d", 8, "x", 1.5, [], "l")]
    source = spark.createDataFrame(rows, "doc_id string, text string, n_lines int, N_DROPPED string, id double, row array<int>, line string")
    out = linededup.drop_lines(source, 3, known_limit=known_limit)
    assert out.columns == [*source.columns, "n_lines_", "n_dropped_"]
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(*rows[0], 1, 0), *[(r[0], "", *r[2:], 1, 1) for r in rows[1:3]], (*rows[3], 1, 0), ("2", "own words of it", *rows[4][2:], 2, 1)])
    assert linededup.clean(source, 3).columns == source.columns


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query(spark, scale):
    d = f"/root/testdata/{scale}"
    got = oracle.same(queries.op5_line_templates(spark, d), queries.ORACLES["op5_line_templates"], d)
    assert any(r["n_dropped"] for r in got)

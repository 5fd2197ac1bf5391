import random

import pytest

from quern.llm import chat, queries


def brute(rows):
    """rows: (conv, turn, speaker, text)."""
    convs = {}
    for c, n, s, t in rows:
        convs.setdefault(c, []).append((n is not None, n, s or "unknown", t or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        for p in {x[2] for x in turns} - {"system"}:
            text, mask = "", ""
            for _, _, s, t in turns:
                head = "system" if s == "system" else "assistant" if s == p else f"user name={s}"
                text += f"<|im_start|>{head}\n{t}<|im_end|>\n"
                mask = mask.ljust(len(text) - len(t) - 11, "0") + ("1" if s == p else "0") * (len(t) + 10) + "0"
            out[c, p] = (text, mask)
    return out


def joined(rows):
    parts = {}
    for r in rows:
        parts.setdefault((r["conv_id"], r["perspective"]), []).append(r)
    out = {}
    for k, own in parts.items():
        text, mask = "", ""
        for r in sorted(own, key=lambda r: r["part"]):
            assert r["start"] == len(text)
            m = ["0"] * len(r["text"])
            for s in r["spans"]:
                m[s["begin"] : s["end"]] = "1" * (s["end"] - s["begin"])
            assert r["n_masked"] == m.count("1")
            text, mask = text + r["text"], mask + "".join(m)
        out[k] = (text, mask)
    return out


@pytest.mark.parametrize("part", [1, 3, 256])
def test_equals_brute_force(spark, part):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(["a", "b", "system", None, "été"]), rng.choice([None, "", "x", "été 漢 y"])) for _ in range(120)]
    rows += [(9, 0, "system", "only"), rows[0], rows[0], (4, 10**6, "z", "long " * 500), (4, -3, "y", "neg"), (4, -300, "z", "very"), (4, -300, None, None), (4, None, "z", "none"), (4, None, "a", "none")]
    source = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    assert joined(chat.rotate(source, part_turns=part).collect()) == brute(rows)


def test_parts_are_bounded(spark):
    source = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "concat('p', id % 3) as role", "'t' as text")
    rows = chat.rotate(source, part_turns=100).collect()
    assert len(rows) == 30 and max(r["n_turns"] for r in rows) == 100


def test_null_and_constant_turns_of_many_rows(spark):
    rows = [(None, None, f"p{k % 3}", f"t{k % 7}") for k in range(400)] + [(1, 5, "a", f"{k}") for k in range(150)] + [(1, 5, "b", "same")] * 150
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate(source, part_turns=2).collect()
    assert joined(out) == brute(rows) and max(r["n_turns"] for r in out) == 2


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query(spark, small):
    rows = [tuple(r) for r in queries.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {(r["conv_id"], r["perspective"]): r["text"] for r in queries.op4_perspective_rotation(spark, small).collect()}
    assert got == {k: v[0] for k, v in brute(rows).items()}

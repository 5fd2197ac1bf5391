"""The dictionary classifier: same codes as its patterns over the whole text, by words."""

import json
import random
import re
import sys
import time

import pytest

from quern.functions import lexicon
from quern.streaming import classify


def by_patterns(prompt):
    """The definition: each topic's and direction's pattern over the whole text, in any case."""
    out = {f"{k}_attention": int(bool(lexicon.python_pattern(terms).search(prompt))) for k, terms in lexicon.TOPIC_TERMS.items()}
    for k, sides in lexicon.DIRECTION_TERMS.items():
        net = len(lexicon.python_pattern(sides["up"]).findall(prompt)) - len(lexicon.python_pattern(sides["down"]).findall(prompt))
        out[f"{k}_outlook"] = (net > 0) - (net < 0) if out[f"{k}_attention"] else 0
    return out


def test_folding_is_that_of_patterns():
    letters = re.compile("[a-z]", re.IGNORECASE)
    one = [re.compile(c, re.IGNORECASE) for c in "abcdefghijklmnopqrstuvwxyz -"]
    for c in map(chr, range(sys.maxunicode + 1)):
        f = classify._folded(c)
        assert len(f) == 1 and bool(re.match(r"\w", c)) == bool(re.match(r"\w", f)), hex(ord(c))
        if letters.match(c) or f in "abcdefghijklmnopqrstuvwxyz -":
            assert [p.pattern for p in one if p.match(c)] == [f], hex(ord(c))


def test_every_term_alone_and_in_part():
    terms = [t for v in lexicon.TOPIC_TERMS.values() for t in v] + [t for sides in lexicon.DIRECTION_TERMS.values() for v in sides.values() for t in v]
    for t in terms:
        for text in (t, t.upper(), f"x{t}", f"{t}s", f"{t}_", f"({t})", t.replace(" ", "  "), t.replace(" ", "\n"), t.replace("-", " "), t[::-1], t.replace("s", "ſ").replace("i", "İ").replace("k", "K")):
            text = f"Inflation, growth: {text}."
            assert json.loads(classify.offline(text)) == by_patterns(text), text
            assert json.loads(classify.offline(text[19:])) == by_patterns(text[19:]), text


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    rng = random.Random(seed)
    terms = [t for v in lexicon.TOPIC_TERMS.values() for t in v] + [t for sides in lexicon.DIRECTION_TERMS.values() for v in sides.values() for t in v]
    words = [*terms, *(w for t in terms for w in re.findall(r"\w+", t)), "the", "ΟΔΟΣ", "straße", "ﬁn", "é", "̇", "Ⅷ", "_", "x" * 50, "7"]
    for _ in range(400):
        text = "".join(rng.choice(words).translate({ord(c): rng.choice([c, c.upper()]) for c in "aeikst"}) + rng.choice([" ", " ", " ", "-", "\n", "  ", "", ".", "̇", "İ", "ſ", "\u00a0", "\u2013", "’", "\ud800", "\x1c"]) for _ in range(rng.randrange(30)))
        assert json.loads(classify.offline(text)) == by_patterns(text), text


def test_whole_table(spark, small):
    from quern.plans import catalogue

    got = {r["doc_id"]: r.asDict() for r in catalogue.QUERIES["offline_classifier"](spark, small).collect()}
    docs = catalogue.table(spark, small, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        assert got[d["doc_id"]] == {"doc_id": d["doc_id"], **by_patterns(d["text"] or ""), "error_type": None, "error_message": None}


def test_takes_a_part_of_the_time_of_patterns(spark, small):
    from quern.plans import catalogue

    texts = [r["text"] or "" for r in catalogue.table(spark, small, "documents").select("text").limit(60).collect()]

    def seconds(f):
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    classify.offline("")
    assert min(seconds(classify.offline) for _ in range(3)) < seconds(by_patterns) / 4

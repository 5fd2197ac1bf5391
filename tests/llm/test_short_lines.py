"""Lines of one and two tokens recur as they stand."""

import collections
import random
import re

import pytest

from quern.llm import linededup, queries

from .samples import docs, prose
from .test_linededup import brute, sample


def whole(texts, min_docs):
    """What the brute force for long lines leaves, without short lines that recur."""
    owners = collections.defaultdict(set)
    short = lambda line: tuple(w) if len(w := re.split("[ \t\r]+", line.strip(" \t\r"))) < linededup.SHORT and w != [""] else None
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            owners[short(line)].add(i)
    out = {}
    for i, (t, n, gone) in brute(texts, min_docs).items():
        kept = None if t is None else [x for x in t.split("\n") if short(x) is None or len(owners[short(x)]) < min_docs or min(owners[short(x)]) == i]
        lost = 0 if t is None else len(t.split("\n")) - len(kept)
        # A text that lost all its lines is split to one blank line, which is no short line.
        out[i] = (None if t is None else "\n".join(kept), n, gone + lost)
    return out


def short_sample(seed):
    rng = random.Random(seed)
    texts = sample(seed)
    for _ in range(40):
        own = [prose(rng, rng.randint(1, 8)) for _ in range(2)] + rng.sample(["Les.", "And ornd.", " And\tornd.\r", "漢字の本", "12", str(rng.randint(0, 99)), "a <*>", ""], 3)
        rng.shuffle(own)
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("min_docs", [2, 5])
@pytest.mark.parametrize("known_limit", [0, linededup.KNOWN_LINES])
def test_equals_brute_force(spark, seed, min_docs, known_limit):
    texts = short_sample(seed)
    got = linededup.drop_lines(docs(spark, texts), min_docs, known_limit=known_limit)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()} == whole(texts, min_docs)


def test_clean_drops_short_lines(spark):
    rng = random.Random(1)
    texts = [f"{prose(rng, 9)} {k}\nLes.\n\nAnd ornd.\n{k}" for k in range(12)]
    kept = {r["doc_id"]: r["text"] for r in linededup.clean(docs(spark, texts)).collect()}
    assert kept[0] == texts[0] and all(kept[k] == f"{texts[k].split(chr(10))[0]}\n\n{k}" for k in range(1, 12))


def test_query_drops_short_lines(spark):
    source = queries.table(spark, "/root/testdata/sf0.01", "documents")
    whole_, long_ = (linededup.drop_lines(source, min_tokens=n).groupBy().sum("n_dropped").first()[0] for n in (1, linededup.SHORT))
    assert whole_ > long_ > 0

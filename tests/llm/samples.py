"""Small awkward tables."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items string, row string"


def docs(spark, texts, langs=None):
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, l, "s", len(t or ""), "x", "y") for i, (t, l) in enumerate(zip(texts, langs, strict=True))], DOCS)


def prose(rng, n, words=("the", "thanwh", "of", "ouea", "shing", "edor", "was", "inat", "bleer", "tion", "élan", "x9", "it's")):
    return " ".join(rng.choice(words) for _ in range(n))


def awkward(seed=0, n=30):
    """Texts with nulls, blanks, copies, shared passages, one very long text."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(1, 60)) for _ in range(n)]
    passage = prose(random.Random(99), 40)
    out += [None, "", "   \n ", "A", out[0], out[0], prose(rng, 20) + " " + passage, passage + "\n" + prose(rng, 5), prose(rng, 4000), "\x1c\x00odd\tбуква 漢字 <|endoftext|> end", out[0], None]
    return out

"""Vocabularies of topics, directions, negators and function words, as data.

Every operator takes its vocabulary as a parameter; these are the defaults.
"""

from __future__ import annotations

import re

# These lists decide what is counted, so they have to be these.

NEGATION_WINDOW = 3

NEGATORS = [
    "not", "no", "nor", "never", "without", "unlikely", "hardly",
    "scarcely", "barely", "little", "few", "lack", "lacking",
    "absent", "neither", "cannot", "unable",
]

TOPIC_TERMS = {
    "inflation": [
        "inflation", "inflationary", "price stability", "price level",
        "prices", "price pressure", "price pressures", "hicp",
        "consumer price", "consumer prices", "cost pressure",
        "cost pressures", "disinflation", "deflation", "deflationary",
        "inflation expectations", "wage pressure", "wage pressures",
        "price developments",
    ],
    "growth": [
        "growth", "economic growth", "gdp", "output",
        "economic activity", "demand",
        "real activity", "domestic demand", "consumption",
        "investment", "recession", "recovery", "expansion",
        "employment", "unemployment", "labour market", "labor market",
        "economic conditions", "business cycle", "demand conditions",
    ],
    "financial_stability": [
        "financial stability", "systemic risk", "banking system",
        "banking sector", "financial system", "financial sector",
        "solvency", "bank capital", "capital buffer",
        "capital buffers", "macroprudential", "contagion",
        "financial fragility", "vulnerabilities", "financial stress",
        "market stress", "bank resilience", "financial imbalances",
        "credit risk", "liquidity risk",
    ],
    "uncertainty": [
        "uncertain", "uncertainty", "uncertainties", "unpredictable",
        "unpredictability", "unclear", "ambiguous", "volatility",
        "volatile", "risks", "risk", "downside risks",
        "upside risks", "alternative scenarios", "wide range",
        "difficult to assess", "hard to predict", "unforeseen",
    ],
}

DIRECTION_TERMS = {
    "inflation": {
        "up": [
            "rise", "rises", "rising", "rose", "increase", "increases",
            "increasing", "increased", "higher", "upside", "upward",
            "accelerate", "accelerating", "acceleration", "persistent",
            "persistence", "pressure", "pressures", "strong",
            "stronger", "strengthening", "elevated", "above target",
            "overheating", "surge", "surging", "mounting", "picking up",
            "second-round", "de-anchoring", "entrenched",
        ],
        "down": [
            "fall", "falls", "falling", "fell", "decline", "declines",
            "declining", "declined", "decrease", "decreasing", "lower",
            "downside", "downward", "subdued", "weak", "weaker",
            "weakening", "moderate", "moderating", "moderation",
            "ease", "easing", "eased", "slow", "slowing", "slowed",
            "below target", "disinflation", "disinflationary",
            "deflation", "deflationary", "dampen", "dampening",
            "muted", "contained", "receded", "receding",
        ],
    },
    "growth": {
        "up": [
            "recovery", "recovering", "recover", "expansion",
            "expanding", "strengthen", "strengthening", "strengthened",
            "improve", "improving", "improved", "robust", "resilient",
            "resilience", "accelerate", "accelerating", "pick up",
            "picking up", "rebound", "rebounding", "buoyant",
            "upswing", "upside", "stronger", "strong", "rising",
            "increase", "increasing", "higher",
        ],
        "down": [
            "slowdown", "slowing", "slow", "weaken", "weakening",
            "weak", "weaker", "contraction", "contracting", "recession",
            "recessionary", "deteriorate", "deteriorating",
            "deterioration", "downturn", "sluggish", "subdued",
            "decline", "declining", "fall", "falling", "downside",
            "lower", "stagnation", "stagnant", "dampen", "dampening",
            "headwinds",
        ],
    },
}

ENGLISH_MARKERS = ["the", "of", "and", "to", "in", "that", "is", "for", "with", "this"]
NON_ENGLISH_MARKERS = [
    "der", "die", "das", "und", "ist", "nicht", "eine", "sich", "auch", "het", "van", "een", "niet",
    "les", "des", "une", "nous", "pour", "dans", "est", "della", "dello", "degli", "sono", "questo",
    "anche", "que", "para", "los", "las", "con", "del",
]
LANGUAGE_SAMPLE_CHARS = 4000
EXCERPT_WORDS = 2000

#: Terms of office, both ends inclusive, the last open.
OFFICES = {
    "president": [
        ("Willem F. Duisenberg", "1998-06-01", "2003-10-31"),
        ("Jean-Claude Trichet", "2003-11-01", "2011-10-31"),
        ("Mario Draghi", "2011-11-01", "2019-10-31"),
        ("Christine Lagarde", "2019-11-01", None),
    ],
    "chief_economist": [
        ("Otmar Issing", "1998-06-01", "2006-05-31"),
        ("Jürgen Stark", "2006-06-01", "2011-12-31"),
        ("Peter Praet", "2012-01-01", "2019-05-31"),
        ("Philip R. Lane", "2019-06-01", None),
    ],
}


def pattern(terms: list[str]) -> str:
    """One Java pattern for whole terms in any case: longest first, so a phrase wins over a word in it. Unicode words."""
    unique = sorted(dict.fromkeys(terms), key=len, reverse=True)
    return r"(?iU)\b(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t) for t in unique) + r")\b"


def python_pattern(terms: list[str]) -> re.Pattern:
    """The same in Python, for cross-checks."""
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(dict.fromkeys(terms), key=len, reverse=True))) + r")\b", re.IGNORECASE)

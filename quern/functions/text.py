"""Column functions over texts: all native, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: White space as Python's ``str.split`` has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def blank_as_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return ~blank_as_empty(c).rlike(r"(?U)[^\s\x1c-\x1f]")


def tokens(c: Column) -> Column:
    """Parts between white space; none for null."""
    return F.filter(F.split(blank_as_empty(c), SPACE), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def excerpt(c: Column, n: int = lexicon.EXCERPT_WORDS) -> Column:
    """The first n tokens, joined by spaces."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def char_length(c: Column) -> Column:
    return F.length(blank_as_empty(c))


def count_terms(c: Column, terms: list[str]) -> Column:
    return F.regexp_count(blank_as_empty(c), F.lit(lexicon.pattern(terms)))


def mentions(c: Column, terms: list[str]) -> Column:
    """Whether any term occurs; null counts as no."""
    return blank_as_empty(c).rlike(lexicon.pattern(terms))


def contains_pattern(columns: list[Column], pattern: str) -> Column:
    """A case-insensitive pattern found in any of the columns; null counts as no."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))
    return found


def language_flags(c: Column, english: list[str] | None = None, other: list[str] | None = None, chars: int = lexicon.LANGUAGE_SAMPLE_CHARS) -> dict[str, Column]:
    """Function words in the opening: english_markers, non_english_markers, non_english."""
    opening = F.substring(blank_as_empty(c), 1, chars)
    en, non = count_terms(opening, english or lexicon.ENGLISH_MARKERS), count_terms(opening, other or lexicon.NON_ENGLISH_MARKERS)
    return {"english_markers": en, "non_english_markers": non, "non_english": non > en}


def density(c: Column, terms: list[str]) -> Column:
    """Terms per 1,000 Unicode words; 0 without words."""
    words = F.regexp_count(blank_as_empty(c), F.lit(r"(?U)\b\w+\b"))
    return F.coalesce(F.try_divide(count_terms(c, terms) * 1000.0, words), F.lit(0.0))


def sentences(c: Column) -> Column:
    """Parts after white space that follows a full stop, exclamation or question mark."""
    return F.split(blank_as_empty(c), r"(?U)(?<=[.!?])[\s\x1c-\x1f]+")


def topic_sentences(c: Column, terms: list[str]) -> Column:
    pattern = lexicon.pattern(terms)
    return F.filter(sentences(c), lambda s: s.rlike(pattern))


def net_direction(sentence: Column, terms: list[str], negators: list[str] | None = None, window: int = lexicon.NEGATION_WINDOW) -> Column:
    """Matches of the terms, each +1, or -1 with a negator among the ``window`` words before it.

    A sentence is cut at the matches, which begin and end at word boundaries, so
    the words before a match are those of the pieces before it. Walking along,
    the last ``window`` of them are kept: each piece is looked at once.
    """
    pattern = lexicon.pattern(terms)
    negator = lexicon.pattern(negators or lexicon.NEGATORS)
    gaps, found = F.split(sentence, pattern, -1), F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))

    def words(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(r"(?U)\b\w+\b"), F.lit(0))

    def last(own: Column) -> Column:
        return F.slice(own, F.greatest(F.size(own) - (window - 1), F.lit(1)), F.lit(window))

    def step(state: Column, k: Column) -> Column:
        near = last(F.concat(state["before"], words(gaps[k])))
        negated = F.exists(near, lambda w: F.regexp_replace(w, negator, "") == "")
        return F.struct(last(F.concat(near, words(found[k]))).alias("before"), (state["net"] + F.when(negated, -1).otherwise(1)).alias("net"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("before"), F.lit(0).alias("net"))
    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, start, step, lambda s: s["net"])


def tone(c: Column, topic: list[str], up: list[str], down: list[str], negators: list[str] | None = None) -> dict[str, Column]:
    """tone (net direction for each topic sentence, 0 without) and n_sentences."""
    own = topic_sentences(c, topic)
    net = F.aggregate(F.transform(own, lambda s: net_direction(s, up, negators) - net_direction(s, down, negators)), F.lit(0), lambda a, x: a + x)
    return {"tone": F.coalesce(F.try_divide(net.cast("double"), F.size(own)), F.lit(0.0)), "n_sentences": F.size(own)}


def score(c: Column, topics: dict | None = None, directions: dict | None = None) -> dict[str, Column]:
    """All of a text's measures: n_words, dens_*, tone_*, n_sent_*."""
    topics, directions = topics or lexicon.TOPIC_TERMS, directions or lexicon.DIRECTION_TERMS
    out = {"dict_n_words": F.regexp_count(blank_as_empty(c), F.lit(r"(?U)\b\w+\b"))}
    out |= {f"dens_{k}": density(c, terms) for k, terms in topics.items()}
    for k, sides in directions.items():
        both = tone(c, topics[k], sides["up"], sides["down"])
        out |= {f"tone_{k}": both["tone"], f"n_sent_{k}": both["n_sentences"]}
    return out


def section_diff(old: str, new: str) -> list[tuple[str, str, str]]:
    """(section, change, line) of two texts with ``# `` headings; blank lines don't count. Changes: added, removed, modified (old then new)."""
    import difflib

    def cut(text: str) -> dict[str, list[str]]:
        out, name = {"": []}, ""
        for line in text.splitlines():
            if line.startswith("#"):
                name = line.lstrip("#").strip()
                out.setdefault(name, [])
            elif line.strip():
                out[name].append(line.strip())
        return out

    a, b, rows = cut(old), cut(new), []
    for name in [*a, *(k for k in b if k not in a)]:
        x, y = a.get(name, []), b.get(name, [])
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            label = {"insert": "added", "delete": "removed", "replace": "modified"}.get(op)
            rows += [(name, label, line) for line in [*x[i:j], *y[k:m]]] if label else []
    return rows

"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is cut
greedily into the longest phrases that occur in a language's training text; the
language that needs the fewest phrases, over the text's length, wins. Parsing
only follows transitions, so the automata are flat tables, and a worker steps
through thousands of blocks of text at once.

Texts are normalised to lower-case letters with single spaces between runs of
them (bytes beyond ASCII count as letters), and parsed whole, in blocks of
``BLOCK`` bytes. A block's end ends a phrase, the same for every language.

The automata are fitted on a bounded sample: at most ``TRAIN_DOCS`` labelled
documents a language and ``TRAIN_BYTES`` normalised bytes of them. Documents are
taken in order of a hash of their id, and equal shares of each, so a hot
source or one long text can't crowd out the rest.

Defined results: a null text, or one without any letter, is ``und`` with score
0; ties go to the language first in order; documents with a null or empty
label don't train; with no labelled document at all everything is ``und``;
repeated rows are judged each; other columns come back as they were, whatever
their names; only the text and (in training) id and label are looked at. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, textscan

BLOCK = 512
TRAIN_DOCS, TRAIN_BYTES = 256, 30_000
#: Phrases a byte beyond which even the winning language doesn't know a text.
STRANGE_RATE = 0.6

#: Bytes of normalised text: letters stay, in lower case, anything else in ASCII is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and n + 1 offsets. A text begins with a letter, and ends with a space if anything stands behind its last one."""
    data, offsets = textscan.string_bytes(texts)
    folded = _FOLD[data]
    keep = folded != 32
    keep[1:] |= keep[:-1].copy() & (folded[1:] == 32)
    head = offsets[:-1][np.diff(offsets) > 0]
    keep[head] = folded[head] != 32
    total = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], total[offsets]


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``text``: it accepts every substring, from state 0."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # byte to column; column 0 has no transitions
    tables: list[np.ndarray]  # state x column, flat; 0 where there is no transition

    @property
    def width(self) -> int:
        return int(self.code.max()) + 1


def fit(texts: dict[str, bytes]) -> Model:
    """From normalised training text of each language."""
    present = sorted({c for t in texts.values() for c in t})
    code = np.zeros(256, np.int64)
    code[present] = np.arange(1, len(present) + 1)
    tables, width = [], len(present) + 1
    for name in sorted(texts):
        steps = automaton(texts[name])
        if len(steps) > 1 << 16:
            raise ValueError("training text of a language is beyond the table's 65,536 states")
        table = np.zeros((len(steps), width), np.uint16)
        for state, step in enumerate(steps):
            for c, to in step.items():
                table[state, code[c]] = to
        tables.append(table.ravel())
    return Model(sorted(texts), code, tables)


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> dict[str, bytes]:
    """Normalised training text of each label, from at most ``train_docs`` documents of each."""
    share = -(-train_bytes // train_docs)
    order = Window.partitionBy("label").orderBy("h", "id")
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("label <> ''").withColumn("h", F.xxhash64("id"))
    counts = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}

    def first(labels: dict[str, int], most: int) -> list:
        """The first rows of each label by hash; only hashes that low can be among them are ranked."""
        bound = F.create_map(*[F.lit(x) for k, n in labels.items() for x in (k, -(2.0**63) + 2.0**64 * min(1.0, most / n))])
        own = named.where(F.col("label").isin(*labels) & (F.col("h") <= bound[F.col("label")]) & F.col("text").rlike(r"\p{L}"))
        own = own.select("id", "label", "h", F.substring("text", 1, 16 * share).alias("text")).withColumn("k", F.row_number().over(order))
        return own.where(F.col("k") <= train_docs).orderBy("label", "k").collect()  # bounded by labels x train_docs x share

    rows = first(counts, 4 * train_docs) if counts else []
    got = {k: sum(r["label"] == k for r in rows) for k in counts}
    short = {k: n for k, n in counts.items() if got[k] < min(train_docs, n)}
    if short:  # labels of which many rows have no letter
        rows = [r for r in rows if r["label"] not in short] + first(short, max(short.values()))
    out: dict[str, bytes] = {}
    for label in sorted({r["label"] for r in rows}):
        data, offsets = normalised(pa.array([r["text"] for r in rows if r["label"] == label], pa.string()))
        own = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sizes, left = [0] * len(own), train_bytes  # equal shares; what short texts leave goes to longer ones
        for i in sorted(range(len(own)), key=lambda i: len(own[i])):
            sizes[i] = min(len(own[i]), left // (len(own) - sum(map(bool, sizes))) if left else 0)
            left -= sizes[i]
        out[label] = b"".join(t[:n] for t, n in zip(own, sizes, strict=True))
    return out


def phrases(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Phrases that each text (row) needs in each language (column)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), counts)
    begin = offsets[:-1][text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(BLOCK, offsets[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, text = begin[order], length[order], text[order]
    active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than t
    out = np.zeros((len(sizes), len(model.languages)), np.int64)
    coded = model.code[data] if len(data) else np.empty(0, np.int64)
    width = model.width
    state = np.zeros((len(model.languages), len(begin)), np.int64)
    need = np.zeros((len(model.languages), len(begin)), np.int64)
    for t in range(int(length[0]) if len(length) else 0):
        n = int(active[t])
        c = coded[begin[:n] + t]
        for k, table in enumerate(model.tables):
            at = state[k, :n]
            to = table[at * width + c]
            stuck = to == 0
            need[k, :n] += stuck | (at == 0)  # a phrase begins with this byte
            stuck = np.flatnonzero(stuck)
            to[stuck] = table[c[stuck]]  # 0 if the byte never occurs: a phrase of its own
            state[k, :n] = to
    for k in range(len(model.languages)):
        np.add.at(out[:, k], text, need[k])
    return out


_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    data, offsets = textscan.string_bytes(texts)
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = bool(_LETTER.search(texts[i].as_py()))
    return out


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, rate and strangeness of each text. The score is by what part the winner needs fewer phrases than the second; the rate is the winner's phrases a byte."""
    data, offsets = normalised(texts)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
    need = phrases(data, offsets, model)
    best = need.argmin(1)
    ranked = np.sort(need, 1)
    score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if need.shape[1] > 1 else np.ones(len(texts))
    ok = lettered(texts)
    return [model.languages[b] if good else "und" for b, good in zip(best.tolist(), ok.tolist(), strict=True)], np.where(ok, score, 0.0), np.where(ok, ranked[:, 0] / np.maximum(np.diff(offsets), 1), 0.0), ok & strange(ranked[:, 0], np.diff(offsets))


def strange(phrases: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a text of so many bytes is surely no text of its language.

    Its first phrase is no evidence, as every text has one. It is strange if the
    others are more than ``STRANGE_RATE`` a byte by two standard deviations; a
    short text can't be told by so few bytes, and isn't.
    """
    return phrases - 1 > STRANGE_RATE * size + 2 * np.sqrt(STRANGE_RATE * (1 - STRANGE_RATE) * size)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``, and behind its columns lang_pred, score, rate and strange (underscores are added to names it has); no shuffle."""
    kept = store.packed(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages x TRAIN_BYTES
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rate", T.DoubleType()), T.StructField("strange", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for i, j in textscan.pieces(batch.column(1), 4 << 20):
                part = batch.slice(i, j - i)
                lang, score, rate, odd = predict(part.column(1), shared.value)
                yield pa.record_batch([*part.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rate), pa.array(odd)], names=["row", "text", "lang_pred", "score", "rate", "strange"])

    return store.unpacked(kept.mapInArrow(run, schema), docs, text_col, "lang_pred", "score", "rate", "strange")


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    return fit(sample(docs, train_docs, train_bytes))

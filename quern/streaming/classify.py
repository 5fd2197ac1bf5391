"""Row-wise external classification: validated, retried, resumed, with an error log.

The classifier is injected: a callable from a prompt to a JSON text. Offline, a
dictionary scorer stands in. No credentials live here.
"""

from __future__ import annotations

import ctypes
import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import coders, lexicon
from ..sources import shared, sinks


class Transient(Exception):
    """A failure worth another try."""


@dataclass(frozen=True)
class Retry:
    """Tries, and the wait before each further one. 6 tries, doubling from 2 s; or 5, growing by the try."""

    tries: int = 6
    seconds: float = 2.0
    growth: str = "exponential"
    on: tuple[type[Exception], ...] = (Transient, json.JSONDecodeError, TimeoutError)

    def wait(self, attempt: int) -> float:
        return self.seconds * (2 ** (attempt - 1) if self.growth == "exponential" else attempt)

    def run(self, call: Callable[[], dict], sleep: Callable[[float], None] = time.sleep) -> dict:
        for attempt in range(1, self.tries + 1):
            try:
                return call()
            except self.on:
                if attempt == self.tries:
                    raise
                sleep(self.wait(attempt))
        raise AssertionError


LINEAR = Retry(tries=5, growth="linear", on=(Transient,))


def validate(record: dict) -> dict:
    """Exactly the six codes, in their domains, no outlook without attention."""
    if set(record) != set(coders.VARIABLES):
        raise ValueError(f"fields are {sorted(record)}")
    for v in coders.VARIABLES:
        if type(record[v]) is not int or record[v] not in coders.categories_for(v):
            raise ValueError(f"{v} is {record[v]!r}")
    for v, a in coders.OUTLOOK.items():
        if record[a] == 0 and record[v] != 0:
            raise ValueError(f"{v} is {record[v]} without {a}")
    return record


JSON_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": coders.VARIABLES,
    "properties": {v: {"type": "integer", "enum": coders.categories_for(v)} for v in coders.VARIABLES},
}


_WORD = re.compile(r"\w+")
#: What re.IGNORECASE takes for an ASCII letter, and str.lower() doesn't or as two characters.
_FOLDS = [("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")]


def _folded(prompt: str) -> str:
    """In lower case as re.IGNORECASE sees ASCII letters, character by character, so terms are found by plain comparison."""
    if not prompt.isascii():
        for letter, as_letter in _FOLDS:
            prompt = prompt.replace(letter, as_letter)
    return prompt.lower()


#: ASCII letters in lower case, and blanks for what ends a word; other bytes as they are.
_ASCII = bytes(b if chr(b).isalnum() or b in b"_" or b > 127 else 32 for b in range(256)).lower()


def _words(prompt: str) -> list[str]:
    """The words of the folded prompt, in some order: ASCII by a table, and what touches other characters by the pattern of words."""
    words = prompt.encode("utf-8", "surrogatepass").translate(_ASCII).decode("utf-8", "surrogatepass").split()
    if prompt.isascii():
        return words
    others = " ".join(w for w in words if not w.isascii())
    return [w for w in words if w.isascii()] + _WORD.findall(_folded(others))


class _Terms:
    """Whole terms in a prompt. Its words settle terms of one word; the pattern is asked only where all words of a longer term occur."""

    def __init__(self, terms: list[str]):
        words = {t: frozenset(_WORD.findall(t)) for t in terms}
        self.single = frozenset(t for t in terms if t in words[t])
        self.longer = [words[t] for t in terms if t not in words[t]]
        self.words = frozenset().union(*words.values())
        self.pattern = re.compile(lexicon.python_pattern(terms).pattern)

    def _phrases(self, words: dict[str, int]) -> bool:
        return any(w <= words.keys() for w in self.longer)

    def found(self, prompt: str, words: dict[str, int]) -> bool:
        return not self.single.isdisjoint(words) or (self._phrases(words) and bool(self.pattern.search(_folded(prompt))))

    def count(self, prompt: str, words: dict[str, int]) -> int:
        return len(self.pattern.findall(_folded(prompt))) if self._phrases(words) else sum(words[w] for w in self.single & words.keys())


@cache
def _vocabularies() -> tuple[dict, dict, frozenset]:
    topics = {k: _Terms(terms) for k, terms in lexicon.TOPIC_TERMS.items()}
    directions = {k: {side: _Terms(terms) for side, terms in sides.items()} for k, sides in lexicon.DIRECTION_TERMS.items()}
    return topics, directions, frozenset().union(*(v.words for v in (*topics.values(), *(v for sides in directions.values() for v in sides.values()))))


def offline(prompt: str) -> str:
    """The dictionary as a classifier: attention where a topic's terms occur, outlook by the sign of its directions."""
    names = {"inflation": "inflation", "growth": "growth", "financial_stability": "financial_stability", "uncertainty": "uncertainty"}
    topics, directions, known = _vocabularies()
    words = _words(prompt)
    hits = known.intersection(set(words))
    words = Counter(w for w in words if w in hits) if hits else {}
    out = {f"{v}_attention": int(topics[k].found(prompt, words)) for k, v in names.items()}
    for k, sides in directions.items():
        net = sides["up"].count(prompt, words) - sides["down"].count(prompt, words) if out[f"{k}_attention"] else 0
        out[f"{k}_outlook"] = (net > 0) - (net < 0)
    return json.dumps(out)


#: Bytes of rows that are classified and handed back at a time.
PIECE = 2 << 20

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library than glibc
    _trim = None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE bytes each; memory is given back to the system behind each batch, as workers are kept between tasks."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
        del batch
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def classify(rows: DataFrame, prompt: str, classifier: Callable[[str], str] = offline, retry: Retry = Retry(), pause: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """``rows`` (all columns, or those to ``keep``) with the six codes, or error_type and error_message; and timestamp_utc. A row that fails doesn't stop the others."""
    at, kept = rows.columns.index(prompt), [i for i, c in enumerate(rows.columns) if keep is None or c in keep]
    added = [*((v, IntegerType()) for v in coders.VARIABLES), ("error_type", StringType()), ("error_message", StringType())]
    schema = StructType([*(StructField(rows.schema[i].name, rows.schema[i].dataType) for i in kept), *(StructField(*c) for c in added)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            got = []
            for p in piece.column(at):
                try:
                    record = retry.run(lambda p=p: validate(json.loads(classifier(p.as_py() or ""))))
                    got.append((*(record[v] for v in coders.VARIABLES), None, None))
                except Exception as e:  # noqa: BLE001  a row's failure is its result
                    got.append((*(None for _ in coders.VARIABLES), type(e).__name__, str(e)[:1000]))
                if pause:
                    time.sleep(pause)
            codes = [pa.array(c, pa.string() if i >= len(coders.VARIABLES) else pa.int32()) for i, c in enumerate(zip(*got, strict=True))]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in kept), *codes], names)

    return rows.mapInArrow(run, schema).withColumn("timestamp_utc", F.current_timestamp())


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals and errors."""
    return results.where("error_type is null").drop("error_type", "error_message"), results.where("error_type is not null").drop(*coders.VARIABLES)


def pending(rows: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return rows if done is None else rows.join(done.select(key).distinct(), key, "left_anti")


def resume(rows: DataFrame, prompt: str, key: str, signals: str, errors: str, **options) -> int:
    """Classifies what is left and appends it; returns how many rows were tried. Results, errors among them, are written once to the shared folder and told apart from there, so no call is made twice, even if an executor is lost."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(signals)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    results = shared.saved(classify(pending(rows, done, key), prompt, **options), "classified")
    n = results.count()
    good, bad = split(results)
    if n:
        sinks.append(good, signals)
        sinks.append(bad, errors)
    return n


def stream(source: DataFrame, prompt: str, key: str, signals: str, errors: str, checkpoint: str, **options):
    """The same as a stream: every micro-batch is classified but for keys already done, so a replayed batch adds nothing."""
    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: resume(batch, prompt, key, signals, errors, **options)).trigger(availableNow=True).start()

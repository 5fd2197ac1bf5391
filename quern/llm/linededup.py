"""Removal of recurring lines by a log-template tree.

Lines go down a tree of fixed depth: by their number of tokens, then by their
``DEPTH`` leading tokens, with any token that has a digit generalised to
``<*>``. In a leaf, a token stays where ``min_docs`` lines' documents or more
share it at its position, and becomes ``<*>`` elsewhere. If enough of a line's
tokens stayed (``SAME``), what came of it is its template; otherwise the line is
its own. A template that ``min_docs`` documents or more have is recurring: the
document with the smallest id keeps its lines of it, all others lose them.

A batch of documents deals its distinct lines to buckets of whole leaves, as
packed token hashes, each with the ``min_docs`` smallest of its document ids:
enough to tell whether there are that many, and which is the first, so a line
that a third of all documents have costs a bucket a few numbers a batch. A
bucket counts tokens, makes templates, and returns the hashes of recurring
lines with their keeper. These are few against the corpus; up to
``KNOWN_LINES`` of them are broadcast and texts are cut where they are read,
beyond that they are joined. The tree is not walked line by line, so the result
doesn't depend on an order.

Defined results: lines are parts between newlines, tokens parts between spaces,
tabs and returns; a line of fewer than ``SHORT`` tokens recurs as it stands,
digits and all (``min_tokens`` may leave short lines out altogether); a blank
line never recurs; a null text has no lines and stays null; a document that loses its last non-blank
line has an empty text left; removed lines leave no blank line behind; repeated
rows of one id are treated alike and count once; rows with a null id stay as
they are and count for nothing, and so do ids that are no integers; other
columns come back as they were, whatever their names. Texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, textscan

MIN_DOCS, SHORT, DEPTH, SAME = 10, 3, 2, 0.8
#: Recurring distinct lines that may be broadcast: 16 bytes each.
KNOWN_LINES = 2_000_000
#: Bytes of text whose lines share a bucket, about.
BUCKET_BYTES = 4 << 20

U = np.uint64
_TOKEN = textscan.byte_class((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
#: The hash of a generalised token, in the 40 bits that are kept of one.
VARIABLE = U(0xB1A5EDC0DE)
_40 = U((1 << 40) - 1)


@dataclass
class Lines:
    """Lines of ``min_tokens`` tokens and more of several texts, in order."""

    text: np.ndarray
    nth: np.ndarray
    begin: np.ndarray  # first token
    size: np.ndarray  # tokens
    token: np.ndarray  # of all lines: 40-bit hashes, digits generalised but in short lines
    leaf: np.ndarray
    line: np.ndarray  # hash of all tokens


def folded(token: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each line's tokens and their places."""
    place = (np.arange(len(token)) - np.repeat(begin, size)).astype(U)
    terms = textscan.mix(token + place * U(0x9E3779B97F4A7C15))
    return textscan.mix(np.add.reduceat(terms, begin) + size.astype(U)) if len(begin) else np.empty(0, U)


def lines_of(texts: pa.Array, min_tokens: int = 1) -> Lines:
    words = textscan.scan(texts, _TOKEN)
    none = np.empty(0, np.int64)
    if not len(words):
        return Lines(none, none, none, none, *(np.empty(0, U),) * 3)
    _, offsets = textscan.string_bytes(texts)
    breaks, digits = (np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]) for mask in (words.data == 10, (words.data >= 48) & (words.data <= 57)))
    exact = words.hashes()
    text, at = words.text_of, breaks[words.starts]
    new = np.ones(len(words), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(words)))
    token = exact & _40
    token[(digits[words.ends] > digits[words.starts]) & np.repeat(size >= SHORT, size)] = VARIABLE
    ok = size >= min_tokens
    kept = np.repeat(ok, size)
    text, nth = text[begin[ok]], at[begin[ok]] - breaks[offsets[text[begin[ok]]]]
    token, exact, size = token[kept], exact[kept], size[ok]
    begin = np.cumsum(size) - size
    # A short line has too few tokens to be told by 40 bits of each.
    whole = np.where(np.repeat(size < SHORT, size), exact, token)
    leaf = size.astype(U)
    for k in range(DEPTH):
        deep = size > k
        leaf[deep] = textscan.mix(leaf[deep] * U(0xD1342543DE82EF95) + whole[begin[deep] + k])
    return Lines(text, nth, begin, size, token, leaf, folded(whole, begin, size))


def gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the tokens of chosen lines."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


DEALT = "bucket int, leaf binary, line binary, size binary, token binary, n binary, doc binary"
_DEALT = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("leaf", "line", "size", "token", "n", "doc")]])
KNOWN = "line long, keeper long"


def smallest(group: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distinct documents of each group: sorted groups and documents."""
    order = np.lexsort((doc, group))
    group, doc = group[order], doc[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    group, doc = group[new], doc[new]
    ok = np.arange(len(group)) - np.searchsorted(group, group, "left") < k
    return group[ok], doc[ok]


def dealt(docs: DataFrame, min_docs: int, buckets: int, min_tokens: int = 1) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in textscan.pieces(batch.column(1), 4 << 20):
                found = [lines_of(batch.column(1).slice(a + i, b - a), min_tokens) for a, b in textscan.pieces(batch.column(1).slice(i, j - i))]
                doc = np.concatenate([ids[i + a + x.text] for (a, _), x in zip(textscan.pieces(batch.column(1).slice(i, j - i)), found, strict=True)])
                line, leaf, size = (np.concatenate([getattr(x, c) for x in found]) for c in ("line", "leaf", "size"))
                if not len(line):
                    continue
                token = np.concatenate([x.token for x in found])
                begin = np.cumsum(size) - size
                _, first, group = np.unique(line, return_index=True, return_inverse=True)
                owner, owned = smallest(group, doc, min_docs)
                counts = np.bincount(owner, minlength=len(first))
                bucket = ((leaf[first] >> U(32)) % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                names, at = np.unique(bucket[order], return_index=True)
                rows: list[list] = [[] for _ in _DEALT]
                starts = np.cumsum(counts) - counts
                for name, a, b in zip(names.tolist(), at, np.append(at[1:], len(order)), strict=True):
                    own = order[a:b]
                    f = first[own]
                    t = token[gather(begin[f], size[f])]
                    d = owned[gather(starts[own], counts[own])]
                    packed = [leaf[f].astype("<u8"), line[f].astype("<u8"), size[f].astype("<u4"), None, counts[own].astype("<u2"), d.astype("<i8")]
                    rows[0].append(name)
                    for k, x in enumerate(packed):
                        rows[k + 1].append(x.tobytes() if x is not None else t.astype("<u4").tobytes() + (t >> U(32)).astype(np.uint8).tobytes())
                yield pa.record_batch([pa.array(r, f.type) for r, f in zip(rows, _DEALT, strict=True)], schema=_DEALT)

    return docs.mapInArrow(run, DEALT)


def recurring(table: pa.Table, min_docs: int, same: float) -> pa.Table:
    """line and keeper: the recurring lines of a bucket of leaves."""
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for row in zip(*[table.column(c) for c in ("leaf", "line", "size", "token", "n", "doc")], strict=True):
        for k, (x, kind) in enumerate(zip(row, ("<u8", "<u8", "<u4", None, "<u2", "<i8"), strict=True)):
            raw = x.as_buffer()
            if kind is None:
                n = len(raw) // 5
                parts[k].append(np.frombuffer(raw, "<u4", n).astype(U) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(U) << U(32))
            else:
                parts[k].append(np.frombuffer(raw, kind))
    leaf, line, size, token, n, doc = (np.concatenate(p) for p in parts)
    size, n = size.astype(np.int64), n.astype(np.int64)
    begin = np.cumsum(size) - size
    # Each distinct line once, with its documents.
    line_of, first, group = np.unique(line, return_index=True, return_inverse=True)
    owner, owned = smallest(np.repeat(group, n), doc, min_docs)
    docs = np.bincount(owner, minlength=len(first))
    token, size, leaf = token[gather(begin[first], size[first])], size[first], leaf[first]
    begin = np.cumsum(size) - size
    place = (np.arange(len(token)) - np.repeat(begin, size)).astype(U)
    key = textscan.mix(np.repeat(leaf, size) + place * U(0xA24BAED4963EE407)) + token
    _, which = np.unique(key, return_inverse=True)
    support = np.bincount(which, np.repeat(docs, size))
    stays = (support[which] >= min_docs) & (token != VARIABLE)
    enough = np.add.reduceat(stays.astype(np.int64), begin) / size >= same
    shape = np.where(np.repeat(enough, size) & ~stays, VARIABLE, token)
    template = textscan.mix(folded(shape, begin, size) + leaf)
    _, name = np.unique(template, return_inverse=True)
    of, having = smallest(name[owner], owned, min_docs)
    often = np.bincount(of, minlength=name.max() + 1) >= min_docs
    keeper = np.zeros(len(often), np.int64)
    keeper[of[::-1]] = having[::-1]  # the smallest is written last
    out = np.flatnonzero(often[name])
    return pa.table({"line": pa.array(line_of[out].view(np.int64)), "keeper": pa.array(keeper[name[out]])})


def known_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same: float = SAME, id_col: str = "doc_id", text_col: str = "text", min_tokens: int = 1) -> DataFrame:
    """line (a hash) and keeper of every line of a recurring template."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * store.shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES + 1)
    return dealt(rows, min_docs, buckets, min_tokens).groupBy("bucket").applyInArrow(textscan.by_group(lambda t: recurring(t, min_docs, same)), KNOWN)


def _cut(text: str, gone: set[int]) -> str:
    return "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, same: float = SAME, id_col: str = "doc_id", text_col: str = "text", known_limit: int = KNOWN_LINES, min_tokens: int = 1) -> DataFrame:
    """``docs`` with recurring lines removed from the text, and behind its columns n_lines and n_dropped (underscores are added to names it has)."""
    own_id = F.expr(f"try_cast({store.quoted(id_col)} as bigint)")
    packed = store.packed(docs, text_col, id=own_id)
    known = store.saved(known_lines(packed, min_docs, same, "id", "text", min_tokens), "line-known")
    if known.count() > known_limit:
        return store.unpacked(_joined(packed, known, min_tokens), docs, text_col, "n_lines", "n_dropped")
    rows = known.toArrow()  # at most known_limit
    line, keeper = rows.column("line").to_numpy().view(U), rows.column("keeper").to_numpy()
    order = np.argsort(line)
    shared = docs.sparkSession.sparkContext.broadcast((line[order], keeper[order]))
    schema = T.StructType([*packed.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, keepers = shared.value
        for batch in textscan.in_turn(batches):
            for i, j in textscan.pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                texts, ids = part.column(1), part.column(2).to_pylist()
                own = lines_of(texts, min_tokens)
                slot = np.minimum(np.searchsorted(hashes, own.line), max(len(hashes) - 1, 0))
                hit = np.flatnonzero(hashes[slot] == own.line) if len(hashes) else np.empty(0, np.int64)
                gone: dict[int, set[int]] = {}
                for t, n, first in zip(own.text[hit].tolist(), own.nth[hit].tolist(), keepers[slot[hit]].tolist(), strict=True):
                    if ids[t] is not None and ids[t] > first:
                        gone.setdefault(t, set()).add(n)
                if gone:
                    values = texts.to_pylist()
                    for t, which in gone.items():
                        values[t] = _cut(values[t], which)
                    left = pa.array(values, pa.string())
                else:
                    left = texts
                data, offsets = textscan.string_bytes(texts)
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                n_lines = np.where(texts.is_valid().to_numpy(zero_copy_only=False), breaks[offsets[1:]] - breaks[offsets[:-1]] + 1, 0)
                dropped = np.array([len(gone.get(t, ())) for t in range(len(part))], np.int64)
                yield pa.record_batch([part.column(0), left, part.column(2), pa.array(n_lines.astype(np.int64)), pa.array(dropped)], names=["row", "text", "id", "n_lines", "n_dropped"])

    return store.unpacked(packed.mapInArrow(run, schema), docs, text_col, "n_lines", "n_dropped")


def _joined(packed: DataFrame, known: DataFrame, min_tokens: int) -> DataFrame:
    """The same where recurring lines are too many to broadcast: lines meet them by hash, documents their lost lines by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in textscan.pieces(batch.column(1)):
                own = lines_of(batch.column(1).slice(i, j - i), min_tokens)
                yield pa.record_batch([pa.array(ids[i + own.text].astype(np.int64)), pa.array(own.line.view(np.int64))], names=["id", "line"])

    rows = packed.select("id", "text").where("id is not null and text is not null")
    # A line goes by its hash, so rows of one id and different texts lose each their own.
    lost = rows.mapInArrow(run, "id long, line long").distinct().join(known, "line").where("id > keeper")
    lost = lost.groupBy("id").agg(F.collect_set("line").alias("lost"))  # at most a document's lines
    schema = T.StructType([*packed.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for k in range(len(batch)):
                part = batch.slice(k, 1)
                texts, text, lines = part.column(2), part.column(2)[0].as_py(), part.column(3)[0].as_py()
                gone: set[int] = set()
                if lines:
                    own = lines_of(texts, min_tokens)
                    gone = set(own.nth[np.isin(own.line.view(np.int64), lines)].tolist())
                left = pa.array([_cut(text, gone)], pa.string()) if gone else texts
                n = 0 if text is None else text.count("\n") + 1
                yield pa.record_batch([part.column(1), left, part.column(0), pa.array([n]), pa.array([len(gone)])], names=["row", "text", "id", "n_lines", "n_dropped"])

    return packed.join(lost, "id", "left").mapInArrow(cut, schema)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without recurring lines, and without the documents that lost all they had to them."""
    out = drop_lines(docs, min_docs)
    dropped = store.column(out.columns[-1])
    return out.where((dropped == 0) | F.col("text").rlike("[^ \\t\\r\\n]")).select(*[store.column(c) for c in docs.columns])


#: The same by SQL, for the query's columns and lines of SHORT tokens and more.
def _long_lines(min_docs: int = MIN_DOCS, same: float = SAME) -> str:
    return f"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, ls, unnest(range(len(ls))) AS nth FROM cut WHERE doc_id IS NOT NULL),
tok AS (SELECT doc_id, nth, list_transform(regexp_split_to_array(trim(ls[nth + 1], ' ' || chr(9) || chr(13)), '[ \\t\\r]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM raw),
l AS (SELECT doc_id, nth, t, array_to_string(t, ' ') AS line, concat_ws(' ', len(t)::VARCHAR, array_to_string(t[1:{DEPTH}], ' ')) AS leaf FROM tok WHERE len(t) >= {SHORT}),
held AS (SELECT l.* FROM l JOIN (SELECT leaf FROM l GROUP BY leaf HAVING count(*) >= {min_docs}) USING (leaf)),
d AS (SELECT leaf, line, any_value(t) AS t, count(DISTINCT doc_id) AS n FROM held GROUP BY leaf, line),
p AS (SELECT leaf, line, n, t, unnest(range(len(t))) AS pos FROM d),
c AS (SELECT leaf, pos, t[pos + 1] AS token FROM p WHERE t[pos + 1] <> '<*>' GROUP BY 1, 2, 3 HAVING sum(n) >= {min_docs}),
s AS (SELECT p.leaf, p.line, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.pos) AS shape, avg(CASE WHEN c.token IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS kept
      FROM p LEFT JOIN c ON c.leaf = p.leaf AND c.pos = p.pos AND c.token = p.t[p.pos + 1] GROUP BY p.leaf, p.line),
named AS (SELECT held.doc_id, held.nth, CASE WHEN s.kept >= {same} THEN s.shape ELSE s.line END AS template FROM held JOIN s USING (leaf, line)),
often AS (SELECT template, min(doc_id) AS keeper FROM named GROUP BY template HAVING count(DISTINCT doc_id) >= {min_docs}),
gone AS (SELECT doc_id, list(DISTINCT nth) AS g FROM named JOIN often USING (template) WHERE doc_id <> keeper GROUP BY doc_id)
SELECT cut.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN g IS NULL THEN array_to_string(ls, chr(10)) ELSE coalesce(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(g, i - 1)), chr(10)), '') END) AS kept_sha256
FROM cut LEFT JOIN gone USING (doc_id)
"""


#: With lines of any length: short ones recur as they stand, and share no template with others.
def oracle(min_docs: int = MIN_DOCS, same: float = SAME) -> str:
    return _long_lines(min_docs, same).replace("FROM named", "FROM every_").replace("often AS (", f"""short AS (SELECT doc_id, nth, regexp_split_to_array(trim(ls[nth + 1], ' ' || chr(9) || chr(13)), '[ \\t\\r]+') AS u FROM raw),
every_ AS (SELECT doc_id, nth, template FROM named UNION ALL SELECT doc_id, nth, array_to_string(u, ' ') FROM short WHERE len(u) < {SHORT} AND u <> ['']),
often AS (""")

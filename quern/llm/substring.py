"""Removal of long word passages that an earlier document has, by difference-cover anchors.

Windows of ``WINDOW`` = 13 words would be many to compare. With the difference
cover {1, 2, 4} modulo 7, any two places i and j have a shift below 7 that
brings both to cover positions; so of any two equal windows, the 7 words from
that shift on are an anchor at a cover position in both. Only those anchors
(three of seven positions) are hashed and compared over the corpus. Where an
anchor stands in more than one document, the windows around it are extended to
their 13 words and compared in full, by 96 bits of hash: a window whose words
also start in a document with a smaller id is removed.

Both comparisons deal hashes to buckets as packed arrays. Before that, a batch
of documents settles what it can by itself: of an anchor, or window, that
several of its documents have, only one goes to the bucket. So a passage that
a third of all documents have costs a bucket one entry a batch.

Places belong to a row, not to an id: where one id has several texts, a row is
its id and a hash of its text (``variant``); where no id has, the variant is 0.

Defined results: a null or blank text has no words; a document of fewer than 13
words loses none; windows that only repeat within a document, or in a row of
the same id, stay; rows of one id and different texts are parts of one
document, each judged by its own words; repeated rows each get a row; a row
with a null id loses none and takes nothing from others; an empty table gives
no rows; columns other than the id and the text are ignored. Texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textscan

WINDOW, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose hashes share a bucket, about.
BUCKET_BYTES = 4 << 20
#: Buckets of hashes for one bucket of documents: what is found is much less than what is compared.
GATHERED = 4

DEALT = "bucket int, n int, h binary, g binary, doc binary, variant binary, pos binary, settled binary"
_DEALT = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("h", "g", "doc", "variant", "pos", "settled")]])
FOUND = "bucket int, n int, doc binary, variant binary, pos binary"
_FOUND = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("doc", "variant", "pos")]])
PLACES = "doc_id long, variant long, pos binary"
_PLACES = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("pos", pa.binary())])


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


def later(order: np.ndarray, begin: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, in ``order``: its group's smallest document, and whether the group has another."""
    sizes = np.diff(np.append(begin, len(order)))
    own = doc[order]
    least = np.repeat(np.minimum.reduceat(own, begin), sizes) if len(order) else own
    most = np.repeat(np.maximum.reduceat(own, begin), sizes) if len(order) else own
    return least, most > least


def deal(h: np.ndarray, g: np.ndarray | None, doc: np.ndarray, variant: np.ndarray, pos: np.ndarray, settled: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows as packed arrays by bucket. Settled rows (1) only pass through, so they are dealt by their document's row."""
    if not len(h):
        return pa.RecordBatch.from_pylist([], schema=_DEALT)
    bucket = np.where(settled == 1, home(doc, variant, buckets), ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32))
    order = np.argsort(bucket, kind="stable")
    names, begin = np.unique(bucket[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    columns = [None if x is None else x[order] for x in (h, g, doc, variant, pos, settled)]
    kinds = (_six, _six, _differences, _differences, _differences, _squeezed)
    packed = [pa.array([b"" if c is None else pack(c[a:b]) for a, b in zip(begin, ends, strict=True)], pa.binary()) for c, pack in zip(columns, kinds, strict=True)]
    return pa.record_batch([pa.array(names), pa.array((ends - begin).astype(np.int32)), *packed], schema=_DEALT)


def _six(h: np.ndarray) -> bytes:
    """The low 48 bits; a bucket's hashes differ there."""
    return h.astype("<u4").tobytes() + (h >> np.uint64(32)).astype("<u2").tobytes()


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.astype(np.uint8).tobytes(), "zstd", asbytes=True)


def _differences(x: np.ndarray) -> bytes:
    return pa.compress(np.diff(x, prepend=0).astype(np.int64).tobytes(), "zstd", asbytes=True)


def undealt(table: pa.Table) -> list[np.ndarray]:
    """h, g, doc, variant, pos and settled of all rows of a bucket."""
    out: list[list[np.ndarray]] = [[np.empty(0, k)] for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8)]
    for n, *packed in zip(*[table.column(c) for c in ("n", "h", "g", "doc", "variant", "pos", "settled")], strict=True):
        n = n.as_py()
        for k, x in enumerate(packed):
            raw = x.as_buffer()
            if k < 2:
                out[k].append(np.frombuffer(raw, "<u4", n if len(raw) else 0) | np.frombuffer(raw, "<u2", n if len(raw) else 0, 4 * n if len(raw) else 0).astype(np.uint64) << np.uint64(32))
            elif k < 5:
                out[k].append(np.cumsum(np.frombuffer(pa.decompress(raw, 8 * n, "zstd"), np.int64)))
            else:
                out[k].append(np.frombuffer(pa.decompress(raw, n, "zstd"), np.uint8))
    return [np.concatenate(x) for x in out]


def home(doc: np.ndarray, variant: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that gathers a row's places."""
    return ((textscan.mix(doc.astype(np.uint64) + textscan.mix(variant.astype(np.uint64)) + np.uint64(0x5DEECE66D)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def sent_home(doc: np.ndarray, variant: np.ndarray, pos: np.ndarray, buckets: int) -> pa.Table:
    """Places as packed arrays by their row's bucket."""
    if not len(doc):
        return _FOUND.empty_table()
    bucket = home(doc, variant, buckets)
    order = np.lexsort((pos, variant, doc, bucket))
    names, begin = np.unique(bucket[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    packed = [pa.array([_differences(c[a:b]) for a, b in zip(begin, ends, strict=True)], pa.binary()) for c in (doc[order], variant[order], pos[order])]
    return pa.table([pa.array(names), pa.array((ends - begin).astype(np.int32)), *packed], schema=_FOUND)


def by_row(table: pa.Table) -> pa.Table:
    """doc_id, variant and all places (differences of int32) of each row of one bucket."""
    parts = [[np.cumsum(np.frombuffer(pa.decompress(x.as_buffer(), 8 * n.as_py(), "zstd"), np.int64)) for n, x in zip(table.column("n"), table.column(c), strict=True)] for c in ("doc", "variant", "pos")]
    doc, variant, pos = (np.concatenate(p) for p in parts)
    order = np.lexsort((pos, variant, doc))
    doc, variant, pos = doc[order], variant[order], pos[order]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]))
    own = [np.diff(pos[a:b], prepend=0).astype("<i4").tobytes() for a, b in zip(begin, np.append(begin[1:], len(pos)), strict=True)]
    return pa.table([pa.array(doc[begin]), pa.array(variant[begin]), pa.array(own, pa.binary())], schema=_PLACES)


def places(x: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(x.as_buffer(), "<i4"), dtype=np.int64)


def long_enough(words: textscan.Words) -> bool:
    return bool((np.diff(words.first) >= WINDOW).any())


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            ids, kinds, hs, ds, vs, ps = *(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2)), [], [], [], []
            for i, j in textscan.pieces(batch.column(1)):
                words = textscan.scan(batch.column(1).slice(i, j - i))
                if not long_enough(words):
                    continue
                h, at = textscan.rolling(words.hashes(), words.first, ANCHOR)
                text = np.searchsorted(words.first, at, "right") - 1
                pos = at - words.first[text]
                ok = np.isin(pos % PERIOD, COVER) & (np.diff(words.first)[text] >= WINDOW)
                hs.append(h[ok])
                ds.append(ids[i + text[ok]])
                vs.append(kinds[i + text[ok]])
                ps.append(pos[ok])
            if not hs:
                continue
            h, doc, variant, pos = np.concatenate(hs), np.concatenate(ds).astype(np.int64), np.concatenate(vs).astype(np.int64), np.concatenate(ps)
            order, begin = groups(h)
            least, shared = later(order, begin, doc)
            # 0: to be compared; 1: known to be shared; 2: known, and compared for its group (one row, the first of the smallest document)
            mine = np.flatnonzero(shared & (doc[order] == least))
            group = np.searchsorted(begin, mine, "right")
            settled = np.empty(len(h), np.uint8)
            settled[order] = shared
            settled[order[mine[np.unique(group, return_index=True)[1]]]] = 2
            yield deal(h, None, doc, variant, pos, settled, buckets)

    return docs.mapInArrow(run, DEALT)


def shared_anchors(table: pa.Table, buckets: int) -> pa.Table:
    h, _, doc, variant, pos, settled = undealt(table)
    at = np.flatnonzero(settled != 1)
    order, begin = groups(h[at])
    _, shared = later(order, begin, doc[at])
    at = at[order]
    ok = shared | (settled[at] == 2)
    if len(at):  # a row known to be shared tells its whole group
        sizes = np.diff(np.append(begin, len(at)))
        ok = np.repeat(np.maximum.reduceat(ok, begin), sizes)
    out = np.concatenate([np.flatnonzero(settled == 1), at[ok]])
    return sent_home(doc[out], variant[out], pos[out], buckets)


def windows(docs: DataFrame, buckets: int) -> DataFrame:
    """Windows around the shared anchors (``pos``) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            batch = batch.filter(batch.column(3).is_valid())
            ids, kinds, found, parts = *(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2)), batch.column(3), []
            for i, j in textscan.pieces(batch.column(1)):
                words = textscan.scan(batch.column(1).slice(i, j - i))
                marks = np.zeros(len(words) + 1, np.int32)
                for k in range(i, j):
                    pos = places(found[k])
                    lo = words.first[k - i]
                    np.add.at(marks, lo + np.maximum(pos - PERIOD + 1, 0), 1)
                    np.add.at(marks, lo + pos + 1, -1)
                wanted = np.cumsum(marks[:-1]) > 0
                h, at = textscan.rolling(words.hashes(1), words.first, WINDOW)
                ok = wanted[at]
                if not ok.any():
                    continue
                g, _ = textscan.rolling(words.hashes(2), words.first, WINDOW, seed=11)
                at = at[ok]
                text = np.searchsorted(words.first, at, "right") - 1
                parts.append((h[ok], g[ok], ids[i + text], kinds[i + text], at - words.first[text]))
            if not parts:
                continue
            h, g, doc, variant, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, variant = doc.astype(np.int64), variant.astype(np.int64)
            order, begin = groups(h, g)
            least, _ = later(order, begin, doc)
            settled = np.empty(len(h), np.uint8)
            settled[order] = doc[order] > least
            yield deal(h, g, doc, variant, pos, settled, buckets)

    return docs.mapInArrow(run, DEALT)


def repeated_windows(table: pa.Table, buckets: int) -> pa.Table:
    h, g, doc, variant, pos, settled = undealt(table)
    at = np.flatnonzero(settled != 1)
    order, begin = groups(h[at], g[at])
    least, _ = later(order, begin, doc[at])
    at = at[order]
    again = at[doc[at] > least]
    out = np.concatenate([np.flatnonzero(settled == 1), again])
    return sent_home(doc[out], variant[out], pos[out], buckets)


def kept_words(docs: DataFrame) -> DataFrame:
    """From repeated window starts (``pos``): n_words, removed spans of words, and the kept words joined by spaces."""
    schema = "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept string"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            found = batch.column(3)
            for i, j in textscan.pieces(batch.column(1), 8 << 20):
                texts = batch.column(1).slice(i, j - i)
                words = textscan.scan(texts)
                n_words, n_removed, spans, kept = np.diff(words.first), np.zeros(j - i, np.int64), [], []
                data = words.data.tobytes()
                for k in range(j - i):
                    lo, hi = int(words.first[k]), int(words.first[k + 1])
                    if not found[i + k].is_valid:
                        spans.append([])
                        kept.append(b" ".join(data[words.starts[lo] : words.ends[hi - 1]].split()) if hi > lo else b"")
                        continue
                    pos = places(found[i + k])
                    marks = np.zeros(hi - lo + 1, np.int32)
                    np.add.at(marks, pos, 1)
                    np.add.at(marks, pos + WINDOW, -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).tolist()
                    spans.append([[a, b] for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    n_removed[k] = int(gone.sum())
                    bounds = [0, *edges, hi - lo]
                    left = [data[words.starts[lo + a] : words.ends[lo + b - 1]] for a, b in zip(bounds[::2], bounds[1::2], strict=True) if b > a]
                    kept.append(b" ".join(w for part in left for w in part.split()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(n_words), pa.array(n_removed), pa.array(spans, arrow.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())], schema=arrow)

    return docs.mapInArrow(run, schema)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed words [first, end)) and kept (the other words, joined by a space)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_text = F.xxhash64(F.coalesce("text", F.lit("")))
    each = docs.groupBy("doc_id").agg(F.min(of_text).alias("lo"), F.max(of_text).alias("hi"), F.sum(F.octet_length("text")).alias("n"))
    size, repeated = each.agg(F.sum("n"), F.max(F.col("doc_id").isNotNull() & (F.col("lo") < F.col("hi")))).first()
    docs = docs.withColumn("variant", of_text if repeated else F.lit(0).cast("long"))
    buckets = max(2 * store.shuffle_partitions(docs.sparkSession), (size or 0) // BUCKET_BYTES + 1)

    def gathered(dealt: DataFrame, settle) -> DataFrame:
        found = dealt.groupBy("bucket").applyInArrow(textscan.by_group(lambda table: settle(table, -(-buckets // GATHERED))), FOUND)
        return found.groupBy("bucket").applyInArrow(textscan.by_group(by_row), PLACES)

    key = ["doc_id", "variant"]
    shared = gathered(anchors(docs.where("doc_id is not null"), buckets), shared_anchors)
    # Two left joins of the same table on the same key: Spark deals its texts once and reads that exchange twice.
    near = docs.join(shared, key, "left").select("doc_id", "text", "variant", "pos")
    again = gathered(windows(near, buckets), repeated_windows)
    return kept_words(docs.join(again, key, "left").select("doc_id", "text", "variant", "pos"))

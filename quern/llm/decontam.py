"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``size`` words (an item of fewer words is one
window). Containment of a window in a document is asked in full, so the
necessary prefix of a window in rarity order is its one rarest word: a document
without it can't hold the window. Rarity is counted over all documents, in one
pass and in ``CELLS`` cells of a word's hash, so that it takes a fixed size
whatever the benchmark (words of one cell share a count; that only moves the
choice of the prefix). A document word equal to a window's rarest word proposes
one start for each place that the word has in windows (positional bound), the
window has to end inside the document (length bound), and its words, folded to
one hash, have to be a window's; then the words at that place are compared one
by one, by 128 bits of hash each. So a word proposes at most ``size`` starts a
window length, in however many windows it is the rarest.

The index of the items is broadcast. It is built in blocks of at most
``BLOCK_WORDS`` item words, so its size is bounded however large the benchmark
is; an item beyond that is cut into parts that overlap by a window. One block
is one map over the documents, with no shuffle. With several, each yields the
rows it hits only, and these few are joined to the documents in the end.

Defined results: a null text has no words and is never hit; a null item id is
no item; several rows of one item id are one item; repeated documents each get
their row; rows of one id are judged by their own texts; an empty benchmark hits
nothing; columns other than the id and the text are ignored. Texts of any
length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, textscan
from .minhash import few

#: Words of items in one broadcast index: some 200 bytes each.
BLOCK_WORDS = 1 << 20
#: Cells of the count of words, and document words whose proposed starts are looked at together.
CELLS, SLICE = 1 << 20, 1 << 18


@dataclass
class Index:
    """Windows of one block of items. ``rare`` is sorted; its entry i has the places (offset, length) of ``begin[i]:begin[i + 1]``; ``key`` is sorted, and goes with the rows of ``words``."""

    rare: np.ndarray
    begin: np.ndarray
    offset: np.ndarray
    length: np.ndarray
    key: np.ndarray
    words: np.ndarray  # windows x size x 2 hashes
    size: np.ndarray  # words of each window
    item_begin: np.ndarray
    item: np.ndarray
    items: list[str]
    sieve: np.ndarray


def sieve(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 18, bool)
    table[(values >> np.uint64(46)).astype(np.int64)] = True
    return table


def member(hashes: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``hashes`` of members of the sorted ``values``, and which."""
    at = np.flatnonzero(table[(hashes >> np.uint64(46)).astype(np.int64)])
    slot = np.searchsorted(values, hashes[at])
    slot[slot == len(values)] = 0
    good = values[slot] == hashes[at] if len(values) else np.zeros(len(at), bool)
    return at[good], slot[good]


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) % CELLS


def folded(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """One hash of the ``length`` words from each start."""
    out = length.astype(np.uint64)
    for k in range(int(length.max(initial=0))):
        more = np.flatnonzero(length > k)
        out[more] = textscan.mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[start[more] + k])
    return out


def scan(texts: pa.Array) -> textscan.Words:
    return textscan.scan(texts, textscan.ALNUM, lower=True)


def build(items: list[tuple[str, str]], counts: np.ndarray, size: int) -> Index:
    """``counts``: documents' words by cell, for rarity."""
    words = scan(pa.array([t for _, t in items], pa.string()))
    h = np.stack([words.hashes(1), words.hashes(2)], 1) if len(words) else np.empty((0, 2), np.uint64)
    names = sorted({name for name, _ in items})
    rank = {name: i for i, name in enumerate(names)}
    sizes = np.diff(words.first)
    n = np.minimum(size, sizes)
    item, k = expand(np.where(sizes > 0, sizes - n + 1, 0))
    start, length = words.first[item] + k, n[item]
    table = np.zeros((len(start), size, 2), np.uint64)
    for j in range(size):
        more = length > j
        table[more, j] = h[start[more] + j]
    owner = np.array([rank[name] for name, _ in items], np.int64)[item]
    # Each distinct window once, with its items.
    flat = np.concatenate([table.reshape(len(start), 2 * size), length[:, None].astype(np.uint64)], 1)
    _, first, which = np.unique(flat, axis=0, return_index=True, return_inverse=True) if len(start) else (None, np.empty(0, np.int64), np.empty(0, np.int64))
    pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
    table, start, length = table[first], start[first], length[first]
    key = folded(h[:, 0], start, length)
    order = np.argsort(key, kind="stable")
    begin = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
    own = [pairs[begin[w] : begin[w + 1], 1] for w in order]
    item_begin = np.cumsum([0, *map(len, own)])
    # The prefix: the place of the rarest word, the first of equally rare ones.
    frequency = np.where(np.arange(size) < length[:, None], counts[cell(table[:, :, 0])], np.iinfo(np.int64).max)
    offset = frequency.argmin(1) if len(first) else np.empty(0, np.int64)
    rare = table[np.arange(len(first)), offset, 0]
    by = np.lexsort((length, offset, rare))
    rare, offset, span = rare[by], offset[by], length[by]
    new = np.ones(len(rare), bool)
    new[1:] = (rare[1:] != rare[:-1]) | (offset[1:] != offset[:-1]) | (span[1:] != span[:-1])
    values, at = np.unique(rare[new], return_index=True)
    return Index(values, np.append(at, new.sum()), offset[new], span[new], key[order], table[order], length[order], item_begin, np.concatenate([np.empty(0, np.int64), *own]), names, sieve(values))


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owners (0, 0, 2, 2, 2) and places (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def occurrences(words: textscan.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and window of each occurrence."""
    h1 = words.hashes(1)
    every, slots = member(h1, index.sieve, index.rare)
    found, h2 = [], None
    for i in range(0, len(every), SLICE):
        at, slot = every[i : i + SLICE], slots[i : i + SLICE]
        who, k = expand(index.begin[slot + 1] - index.begin[slot])
        place = index.begin[slot[who]] + k
        start, length = at[who] - index.offset[place], index.length[place]
        text = np.searchsorted(words.first, at[who], "right") - 1
        ok = (start >= words.first[text]) & (start + length <= words.first[text + 1])
        start, length, text = start[ok], length[ok], text[ok]
        key = folded(h1, start, length)
        lo, hi = np.searchsorted(index.key, key, "left"), np.searchsorted(index.key, key, "right")
        who, k = expand(hi - lo)
        window, start, length, text = lo[who] + k, start[who], length[who], text[who]
        ok = index.size[window] == length
        window, start, length, text = window[ok], start[ok], length[ok], text[ok]
        if len(start) and h2 is None:
            h2 = words.hashes(2)
        for h, part in ((h1, 0), (h2, 1)):
            for j in range(index.words.shape[1] if len(start) else 0):
                ok = (j >= length) | (h[np.minimum(start + j, len(h) - 1)] == index.words[window, j, part])
                window, start, length, text = window[ok], start[ok], length[ok], text[ok]
        found.append((text, start, window))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), (), ())))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def counted(docs: DataFrame) -> np.ndarray:
    """How often the words of each cell stand in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in textscan.in_turn(batches):
            for i, j in textscan.pieces(batch.column(0)):
                total += np.bincount(cell(scan(batch.column(0).slice(i, j - i)).hashes(1)), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    rows = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS
    out = np.zeros(CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def parts(text: str, size: int, most: int) -> Iterator[tuple[str, int]]:
    """An item's text and its number of words; one of more than ``most`` words in parts that share no window and lose none."""
    words = scan(pa.array([text], pa.string()))
    n, step = len(words), max(most, size)
    if n <= step:
        yield text, n
        return
    for i in range(0, n - size + 1, step - size + 1):
        j = min(i + step, n)
        yield words.data[words.starts[i] : words.ends[j - 1]].tobytes().decode(), j - i


def cut(benchmark: DataFrame, item_col: str, item_text_col: str, size: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Blocks of items, or of their parts, of at most ``most`` words (at least one part), in order of ids; one empty block if there is none."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("i is not null and t is not null")
    block, filled, any_ = [], 0, False
    for row in items.orderBy("i", "t").toLocalIterator():
        for text, n in parts(row["t"], size, most):
            if block and filled + n > most:
                yield block
                block, filled, any_ = [], 0, True
            block.append((row["i"], text))
            filled += n
    if block or not any_:
        yield block


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))]
_SPANS, _ITEMS = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())


def matched(docs: DataFrame, index: Index, keep: list[str], every: bool) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_words, spans and items; ``every`` row, or those hit."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*[docs.schema[c] for c in keep], *FOUND])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in textscan.in_turn(batches):
            texts = batch.column(batch.schema.get_field_index("text"))
            for i, j in textscan.pieces(texts):
                words = scan(texts.slice(i, j - i))
                text, start, window = occurrences(words, index)
                if not every and not len(text):
                    continue
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + index.size[window], -1)
                hit = np.cumsum(edges[:-1]) > 0
                named: list[set] = [set() for _ in range(j - i)]
                seen = np.unique(np.stack([text, window], 1), axis=0)
                for t, w in seen.tolist():
                    named[t].update(index.items[x] for x in index.item[index.item_begin[w] : index.item_begin[w + 1]].tolist())
                spans: list[list] = [[] for _ in range(j - i)]
                for t in np.unique(text).tolist():
                    spans[t] = [[a, b] for a, b in runs(hit[words.first[t] : words.first[t + 1]])]
                columns = [batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in keep]
                out = pa.record_batch([*columns, pa.array(np.diff(words.first)), pa.array(spans, _SPANS), pa.array([sorted(x) for x in named], _ITEMS)], names=schema.names)
                yield out if every else out.filter(pa.array([bool(x) for x in spans]))

    return docs.mapInArrow(run, schema)


def variant(text: Column | str) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def found(keyed: DataFrame, blocks: Iterable[list[tuple[str, str]]], counts: np.ndarray, size: int) -> DataFrame:
    """A row for each id and text (doc_id, variant) that one block or another hits, with spans and items."""
    out = None
    for block in blocks:
        own = store.saved(matched(keyed, build(block, counts, size), ["doc_id", "variant"], False).dropDuplicates(["doc_id", "variant"]), "decontam")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("doc_id", "variant").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))  # at most a row a block


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep_row: bool = False) -> DataFrame:
    """A row for each document: doc_id, n_words, the hit words as spans [first, end) and the item ids that occur, in order of their strings; with ``keep_row`` also the whole document as the struct ``row``."""
    row = [F.struct(*[store.column(c).alias(c) for c in docs.columns]).alias("row")] if keep_row else []
    text = store.column(text_col).cast("string")
    docs = docs.select(store.column(id_col).cast("long").alias("doc_id"), text.alias("text"), *row)
    keep = [c for c in docs.columns if c != "text"]
    counts = counted(docs)
    blocks = cut(benchmark, item_col, item_text_col, size, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return matched(docs, build(first, counts, size), keep, True).select("doc_id", "n_words", "spans", "items", *keep[1:])
    # The first block's map has every document's words.
    keyed = docs.withColumn("variant", variant("text"))
    together = found(keyed, itertools.chain([first, second], blocks), counts, size)
    none = build([], counts, size)
    words = matched(keyed, none, [*keep, "variant"], True).drop("spans", "items").withColumnsRenamed({"doc_id": "d", "variant": "v"})
    joined = words.join(together, words["d"].eqNullSafe(together["doc_id"]) & (words["v"] == together["variant"]), "left")
    spans = F.coalesce(F.array_sort("spans"), F.array().cast("array<array<int>>"))
    return joined.select(F.col("d").alias("doc_id"), "n_words", merged(spans).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *keep[1:])


def merged(spans):
    """Sorted spans, where those that touch are one."""
    empty = F.array().cast("array<array<int>>")

    def step(out, s):
        last = F.try_element_at(out, F.lit(-1))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], s[1]))))
        return F.when((F.size(out) > 0) & (last[1] >= s[0]), grown).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, empty, step)


def digest(found: DataFrame, threshold: int = 2) -> DataFrame:
    """Counts and digests of ``hits``; a document is contaminated if ``threshold`` items or more occur."""
    span = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", span.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= threshold).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 8, threshold: int = 1) -> DataFrame:
    """``docs`` without the documents that hold windows of ``threshold`` items or more; the others stay as they are.

    One item's window is a leak, so by default one is enough to go; ``digest`` has its own threshold.
    Workers get ids and texts and give back those hit, so that no document stands in memory several times over.
    """
    if threshold < 1:  # any document holds that many
        return docs.where(F.lit(False))
    text = store.column("text").cast("string")
    key = {"doc_id": store.column("doc_id").cast("long"), "variant": variant(text)}
    keyed = docs.select(text.alias("text"), *[c.alias(n) for n, c in key.items()])
    hit = found(keyed, cut(benchmark, "item_id", "text", size, BLOCK_WORDS), counted(keyed), size)
    gone = store.saved(hit.where(F.size("items") >= threshold).select(F.col("doc_id").alias("d"), F.col("variant").alias("v")), "decontam-gone")
    rows = docs.select(F.struct(*map(store.column, docs.columns)).alias("row"), *[c.alias(n) for n, c in key.items()])
    return rows.join(few(gone), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("variant") == F.col("v")), "left_anti").select("row.*")

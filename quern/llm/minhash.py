"""Near-duplicate classes by weighted MinHash signatures from thrown darts.

A document is the multiset of its shingles of five words. Every unit of a
shingle's weight is a cell of its own (shingle, how-manieth), crossed with a
rank axis cut into strips. Darts fall into a cell's strip by a hash of cell and
strip: a Poisson number, each with a rank inside the strip and a coordinate of
the signature. The signature keeps the dart of least rank at each coordinate.
The lowest strip is so thin that almost no cell of a long text has a dart in
it; wider strips are thrown only for texts whose coordinates aren't all filled
yet. So a text costs one hash for each shingle, and some hundreds of darts.
Two signatures agree at a coordinate with the probability of the weighted
Jaccard similarity, whatever the sizes.

Signatures are cut into bands; texts that agree on a band are candidates. A node
is a distinct text: exact copies (of the words, in lower case) are one. A
bucket's members are compared with its head in exact weighted Jaccard
similarity, on whole texts. The head is the member with the most neighbours in
all its buckets: of a group of edited copies that is the one with the fewest
edits, as a rule, and it links most of the others. Links make classes
(connected components, found by minima that run along links; nothing is
collected). Where a bucket still holds several classes, its members' sketches
(``COORDINATES`` coordinates, two bits and then a byte of each dart) are compared
across classes, block by block, and pairs whose sketches agree often enough, and that are about
as far as each other from each head they share (Jaccard distance is a metric),
are compared in full: first the likeliest few of each node, then, in new
classes, all, each pair in the first band that it shares. So a large group of
copies costs blocks of byte comparisons, and pairs only where a link may still
matter.

Joins on a class or a head meet one key very often where a class is large; the
other side has one row of a key, and these rows are a few numbers, so Spark's
adaptive skew join splits such a key over tasks.

Defined results: a class is named by its smallest document id, so a document
without near-duplicates is a class of its own; so is every null or blank text;
a text of fewer than five words is one shingle; rows of one id are one document,
and where their texts differ it is near whatever one of them is near to; ids
that are null are left out; an empty table has no rows; columns other than the
id and the text are ignored. Texts of any length are read whole.
``deduplicated`` judges rows, not ids: see there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textscan

U = np.uint64
SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8, a pair is missed by all bands once in 20,000; at 0.9, once in 10 billion.
BANDS, ROWS = 25, 5
#: Coordinates of a sketch (the bands use the first of them), and the part that has to agree. At similarity 0.8 fewer agree once in 70,000 pairs.
COORDINATES, AGREEING = 384, 0.714
#: Rows of a block of sketches, and pairs of a document in the first round.
BLOCK_ROWS, FIRST_PAIRS = 1024, 4
#: Two bits of each dart are compared first. Fewer agree once in 70,000 pairs of similarity 0.8 (where 0.85 of them do).
AGREEING_BITS = 0.774
#: Rows of a few numbers each (candidates, pairs, shared bands) that may be broadcast to find their texts and signatures; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: The lowest strip of ranks ends at 2**BASE; each further one doubles that.
BASE = -6


def shingles(words: textscan.Words, hashes: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each shingle; a text of fewer than ``size`` words, but not none, is one."""
    counts = np.diff(words.first)
    h, at = textscan.rolling(hashes, words.first, size)
    text = np.searchsorted(words.first, at, "right") - 1
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        own = np.zeros(len(few), U)
        for k in range(size - 1):
            more = counts[few] > k
            i = np.minimum(words.first[few] + k, len(hashes) - 1)
            own = np.where(more, textscan.mix(own * U(0x9E3779B97F4A7C15) + hashes[i] + U(k + 1)), own)
        text, h = np.concatenate([text, few]), np.concatenate([h, own])
        order = np.argsort(text, kind="stable")
        text, h = text[order], h[order]
    return text, h


def counted(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each shingle, how many equal ones stand before it in its text (in some order)."""
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    begin = np.flatnonzero(new)
    out = np.empty(len(h), np.int64)
    out[order] = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return out


@cache
def poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2, ... as 64-bit fractions."""
    k = np.arange(int(mean + 12 * mean**0.5) + 24)
    log = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
    total = np.minimum(np.cumsum(np.exp(log)), 1.0)
    return np.array([min(int(x * 2**64), 2**64 - 1) for x in total.tolist()], U)


def signatures(text: np.ndarray, cells: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """Least darts of each of ``n`` texts: n x size. ``cells`` hash a shingle and its count. Texts without cells stay 0."""
    out, open_ = np.zeros((n, size), U), np.zeros(n, bool)
    filled = np.zeros((n, size), bool)
    open_[text] = True
    k = 0
    while open_.any():
        low, high = (0.0 if k == 0 else 2.0 ** (BASE + k - 1)), 2.0 ** (BASE + k)
        live = open_[text]
        own_text, own = (text, cells) if live.all() else (text[live], cells[live])
        strip = U(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)
        seed = textscan.mix(own ^ strip)
        counts = np.searchsorted(poisson(high - low), seed, "left") if k > 4 else _few(seed, high - low)
        hit = np.flatnonzero(counts)
        owner = np.repeat(hit, counts[hit])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts[hit]) - counts[hit], counts[hit])
        dart = textscan.mix(seed[owner] + (nth.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
        place = own_text[owner] * size + (dart % U(size)).astype(np.int64)
        free = ~filled.ravel()[place]
        place, dart = place[free], dart[free]
        order = np.argsort(textscan.mix(dart))[::-1]  # ranks inside the strip; the least is written last
        out.ravel()[place[order]] = dart[order]
        filled.ravel()[place] = True
        open_ &= ~filled.all(1)
        k += 1
    return out


def _few(seed: np.ndarray, mean: float) -> np.ndarray:
    """The same numbers as by ``poisson``, for small means: most cells have none."""
    table = poisson(mean)
    out = np.zeros(len(seed), np.int64)
    some = np.flatnonzero(seed > table[0])
    out[some] = np.searchsorted(table, seed[some], "left")
    return out


def scan(texts: pa.Array) -> textscan.Words:
    return textscan.scan(texts, lower=True)


def described(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, variant, key (128 bits of all words; null without words), n (shingles), bands (a hash each), sketch."""
    schema = "doc_id long, variant long, key binary, n long, bands array<long>, sketch binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    width = -(-max(COORDINATES, bands * rows) // 32) * 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for i, j in textscan.pieces(batch.column(1)):
                words = scan(batch.column(1).slice(i, j - i))
                h1, n = words.hashes(1), j - i
                text, h = shingles(words, h1, size)
                nth = counted(text, h)
                cells = textscan.mix(h + nth.astype(U) * U(0x589965CC75374CC3))
                darts = signatures(text, cells, n, width)
                sig = darts[:, : bands * rows].reshape(n, bands, rows)
                sketch = (darts >> U(40)).astype(np.uint8).tobytes()
                band = np.zeros((n, bands), U)
                for r in range(rows):
                    band = textscan.mix(band * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                h2 = words.hashes(2)
                keys = np.zeros((n, 2), U)
                for c, hs in enumerate((h1, h2)):
                    weighted = textscan.mix(hs + (np.arange(len(hs)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(U) * U(0x1D8E4E27C47D124F))
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(weighted, dtype=U)])
                    keys[:, c] = sums[words.first[1:]] - sums[words.first[:-1]]
                has = np.diff(words.first) > 0
                raw = keys.tobytes()
                key = pa.array([raw[16 * k : 16 * k + 16] if ok else None for k, ok in enumerate(has.tolist())], pa.binary())
                flat = pa.array(band.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), flat)
                yield pa.record_batch([batch.column(0).slice(i, n), batch.column(2).slice(i, n), key, pa.array(np.bincount(text, minlength=n)), lists, pa.array([sketch[width * k : width * (k + 1)] for k in range(n)], pa.binary())], schema=arrow)

    return docs.mapInArrow(run, schema)


def similarity(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of two columns of texts, row by row."""
    n, sides = len(a), []
    for texts in (a, b):
        words = scan(texts)
        sides.append(shingles(words, words.hashes(1), size))
    text = np.concatenate([t for t, _ in sides])
    h = np.concatenate([x for _, x in sides])
    side = np.repeat(np.array([1, -1]), [len(sides[0][0]), len(sides[1][0])])
    order = np.lexsort((h, text))
    text, h, side = text[order], h[order], side[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return np.zeros(n)
    apart = np.bincount(text[begin], np.abs(np.add.reduceat(side, begin)), n)
    both = np.bincount(text, minlength=n)
    return (both - apart) / np.maximum(both + apart, 1)  # sum of min over sum of max


def few(rows: DataFrame) -> DataFrame:
    """``rows`` of a saved table, for a join with a wider one: broadcast unless there are too many."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def compared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``pairs`` (a, b; a saved table) with their similarity."""
    schema = "a long, b long, s double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for i, j in textscan.pieces(batch.column(2), 1 << 20):
                part = batch.slice(i, j - i)
                for k in range(0, len(part), 256):
                    own = part.slice(k, 256)
                    yield pa.record_batch([own.column(0), own.column(1), pa.array(similarity(own.column(2), own.column(3), size))], names=["a", "b", "s"])

    ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    tb = tb.join(few(store.saved(pairs.select("b").distinct(), "minhash-asked")), "b", "left_semi")  # texts that no pair asks for stay where they are
    return few(pairs).join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(run, schema)


def components(links: DataFrame) -> DataFrame:
    """id, class for each end of ``links`` (a, b): the least id that links lead to."""
    both = store.saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "minhash-links")
    label = store.saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("class")), "minhash-labels")
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("class").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", F.least("class", "m").alias("c"), F.col("class").alias("old"))
        up = label.select(F.col("id").alias("c"), F.col("class").alias("up"))
        new = store.saved(step.join(up, "c").select("id", F.least("c", "up").alias("class"), (F.least("c", "up") != F.col("old")).alias("moved")), "minhash-labels")
        label = new.select("id", "class")
        if not new.where("moved").limit(1).count():
            return label


def unsettled(members: DataFrame, label: DataFrame, signed: DataFrame, near: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one class, with class, size, bands, sketch and similarities to their buckets' heads."""
    known = members.join(label, members["node"] == label["id"], "left").select("band", "v", "node", F.coalesce("class", "node").alias("class"))
    known = store.saved(known, "minhash-known")
    split = known.groupBy("band", "v").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("band", "v", "m")
    rest = store.saved(known.join(store.saved(split, "minhash-split"), ["band", "v"]), "minhash-rest")
    return rest.join(signed, "node").join(near, "node")


def likely(rest: DataFrame, threshold: float, agreeing: float, agreeing_bits: float, first: int | None) -> DataFrame:
    """a, b: pairs across classes whose sizes and sketches let a link be.

    A bucket is cut into blocks by a hash; each two blocks are one task's work.
    With ``first`` a document looks in its first band only, into its own block
    and the two beside it, for its so many likeliest partners in each.
    """
    blocks = F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    if first is not None:
        others = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(own + k, blocks)))
    asks = F.col("band") == F.min("band").over(Window.partitionBy("node"))
    dealt = rest.withColumns({"own": own, "other": F.explode(others), "asks": asks if first is not None else F.lit(True)})
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "asks", "band", "v", "node", "class", "n", "bands", "sketch", "near")

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        doc, cls, n = (table.column(c).to_numpy() for c in ("node", "class", "n"))
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(doc), -1)
        sketch = np.frombuffer(b"".join(x.as_py() for x in table.column("sketch")), np.uint8).reshape(len(doc), -1)
        listed = table.column("near").combine_chunks()
        sizes, listed = np.diff(listed.offsets.to_numpy()), listed.flatten()
        near = np.full(bands.shape, np.nan, np.float32)
        near[np.repeat(np.arange(len(doc)), sizes), listed.field("band").to_numpy()] = listed.field("s").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        few = two_bits(sketch)
        far = int((1 - agreeing_bits) * sketch.shape[1])
        found = []
        for k in range(0, len(left), 128):
            x = left[k : k + 128]
            ok = (cls[x][:, None] != cls[right][None, :]) & (np.minimum(n[x][:, None], n[right][None, :]) >= threshold * np.maximum(n[x][:, None], n[right][None, :]))
            if i == j:
                ok &= doc[x][:, None] < doc[right][None, :]
            if not ok.any():
                continue
            ok &= unlike(few[:, x], few[:, right]) <= far
            p, q = np.nonzero(ok)
            same = np.concatenate([(sketch[x[p[k : k + 4096]]] == sketch[right[q[k : k + 4096]]]).sum(1) for k in range(0, len(p), 4096)] or [np.empty(0, np.int64)])
            fits = same >= agreeing * sketch.shape[1]
            p, q, same = p[fits], q[fits], same[fits]
            # Both were compared with the head of each bucket they share: a link's ends are about as far from it.
            apart = np.abs(near[x[p]] - near[right[q]]) > 1 - threshold + 1e-6
            fits = ~(apart & (bands[x[p]] == bands[right[q]])).any(1)
            p, q, same = p[fits], q[fits], same[fits]
            if first is None:  # a pair is compared in the first band that it shares
                seen = (bands[x[p], :band] == bands[right[q], :band]).any(1)
                p, q, same = p[~seen], q[~seen], same[~seen]
            found.append((x[p], right[q], same))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        if first is not None and len(a):
            asks, keep = table.column("asks").to_numpy(), np.zeros(len(a), bool)
            for side in (a, b):
                order = np.lexsort((a + b, -s, side))
                place = np.arange(len(order)) - np.searchsorted(side[order], side[order], "left")
                chosen = order[place < first]
                keep[chosen[asks[side[chosen]]]] = True
            a, b = a[keep], b[keep]
        return pa.table({"a": pa.array(np.minimum(doc[a], doc[b]), pa.int64()), "b": pa.array(np.maximum(doc[a], doc[b]), pa.int64())})

    # Blocks are small and their work is not: more tasks than Spark would take for so few bytes.
    rows_dealt = rest.agg(F.sum(blocks)).first()[0] or 0
    tasks = max(store.shuffle_partitions(rest.sparkSession), rows_dealt // (4 * BLOCK_ROWS))
    return dealt.repartition(int(tasks), "band", "v", "i", "j").groupBy("band", "v", "i", "j").applyInArrow(run, "a long, b long")


def two_bits(sketch: np.ndarray) -> np.ndarray:
    """The low two bits of each dart, 32 darts a word: darts x rows."""
    bits = (sketch & 3).astype(U).reshape(len(sketch), -1, 32)
    return np.ascontiguousarray(np.bitwise_or.reduce(bits << (U(2) * np.arange(32, dtype=U)), axis=2).T)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many darts differ in two bits, for each column of ``a`` with each of ``b``."""
    out = np.zeros((a.shape[1], b.shape[1]), np.uint16)
    for x, y in zip(a, b, strict=True):
        apart = x[:, None] ^ y[None, :]
        apart |= apart >> U(1)
        apart &= U(0x5555555555555555)
        out += np.bitwise_count(apart)
    return out


def linked(docs: DataFrame, threshold: float, size: int, bands: int, rows: int, first_pairs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text, variant): each row's description, the heads (key, and a node with its least row) and the nodes' classes (id, class)."""
    each = store.saved(described(docs, bands, rows, size).withColumn("node", F.monotonically_increasing_id()), "minhash-signatures")
    one = each.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "variant", "node")).alias("r")).select("key", "r.*")
    heads = store.saved(one, "minhash-texts")
    # Signatures are wide: bands move once, and whole ones are kept apart for the nodes that share a bucket.
    entries = store.saved(each.join(heads.select("node"), "node", "left_semi").select("node", "bands"), "minhash-bands").select(F.posexplode("bands").alias("band", "v"), "node")
    shared = store.saved(entries.groupBy("band", "v").agg(F.count("*").alias("m")).where("m > 1"), "minhash-buckets")
    entries = store.saved(entries.join(few(shared), ["band", "v"]), "minhash-entries")
    entries = entries.join(entries.groupBy("node").agg(F.sum("m").alias("w")), "node")
    chosen = entries.groupBy("band", "v").agg(F.max(F.struct("w", (-F.col("node")).alias("node"))).alias("r")).select("band", "v", (-F.col("r.node")).alias("head"))
    members = store.saved(entries.select("band", "v", "node").join(chosen, ["band", "v"]), "minhash-members")
    wanted = heads.join(members.select("node").distinct(), "node", "left_semi").select("doc_id", "variant", "node")
    wanted = store.saved(wanted, "minhash-wanted")
    signed = store.saved(each.select("node", "n", "bands", "sketch").join(few(wanted.select("node")), "node", "left_semi"), "minhash-signed")
    found = docs.join(few(wanted), ["doc_id", "variant"]).select("node", "text")
    if each.join(few(wanted.select("doc_id", "variant")), ["doc_id", "variant"], "left_semi").count() > wanted.count():  # equal rows
        found = found.dropDuplicates(["node"])
    texts = store.saved(found, "minhash-candidates")
    star = store.saved(members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "minhash-pairs")
    done = store.saved(compared(star, texts, size), "minhash-star")
    links = done.where(F.col("s") >= threshold).select("a", "b")
    each_head = members.join(done, (F.col("node") == F.col("a")) & (F.col("head") == F.col("b")), "left").select("node", "band", F.coalesce("s", F.lit(1.0)).cast("float").alias("s"))
    near = store.saved(each_head.groupBy("node").agg(F.collect_list(F.struct("band", "s")).alias("near")), "minhash-near")  # at most a row's bands
    label = components(links)
    least = AGREEING + (threshold - THRESHOLD)
    seen = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # pairs stand with the smaller first
    for at_most in (first_pairs, None):
        rest = unsettled(members, label, signed, near)
        more = store.saved(likely(rest, threshold, least, AGREEING_BITS + 0.75 * (threshold - THRESHOLD), at_most).distinct().join(seen, ["a", "b"], "left_anti"), "minhash-likely")
        seen = seen.union(more)
        new = store.saved(compared(more, texts, size).where(F.col("s") >= threshold).select("a", "b"), "minhash-links")
        if new.limit(1).count():
            links = links.union(new)
            label = components(links)
    return each, heads, label


def grouped(heads: DataFrame, label: DataFrame) -> DataFrame:
    """Of each head: its key and the least row (class_id, class_variant) of its class."""
    known = heads.join(label, heads["node"] == label["id"]).select("node", "doc_id", "variant", "class")
    least = known.groupBy("class").agg(F.min(F.struct("doc_id", "variant")).alias("r"))
    named = known.join(least, "class").select("node", F.col("r.doc_id").alias("class_id"), F.col("r.variant").alias("class_variant"))
    return heads.join(named, "node", "left").select("key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_variant", "variant").alias("class_variant"))


def _rows(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("variant"), *more)


def classes(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", first_pairs: int = FIRST_PAIRS) -> DataFrame:
    """doc_id and class_id, a row for each document."""
    docs = _rows(docs, id_col, text_col).where("doc_id is not null")
    each, heads, label = linked(docs, threshold, size, bands, rows, first_pairs)
    # An id with several texts holds their classes together.
    several = each.where("key is not null").groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    if several.limit(1).count():
        held = each.where("key is not null").select("doc_id", "key").distinct().join(several, "doc_id").join(heads.select("key", "node"), "key")
        first = held.groupBy("doc_id").agg(F.min("node").alias("b"))
        label = components(label.select(F.col("id").alias("a"), F.col("class").alias("b")).union(held.join(first, "doc_id").select(F.col("node").alias("a"), "b")).where("a <> b"))
    named = store.saved(grouped(heads, label), "minhash-classes")
    all_ = each.groupBy("doc_id").agg(F.max("key").alias("key"))
    return all_.join(named, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", first_pairs: int = FIRST_PAIRS) -> DataFrame:
    """One row of each group of near-duplicate texts, whole: the one of the smallest id (then hash of the text).

    Here rows are documents: texts that only share an id all stay. Of rows with
    equal id and text one stays, that with the least hash of all its columns.
    Rows without words are no one's duplicates; rows without an id stay as they are.
    """
    packed = _rows(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    each, heads, label = linked(packed.where("doc_id is not null").drop("row"), threshold, size, bands, rows, first_pairs)
    named = store.saved(grouped(heads, label), "minhash-classes")
    known = each.groupBy("doc_id", "variant").agg(F.count("*").alias("n"), F.max("key").alias("key")).join(named, "key", "left")
    gone = F.coalesce((F.col("doc_id") != F.col("class_id")) | (F.col("variant") != F.col("class_variant")), F.lit(False))
    marks = store.saved(known.select("doc_id", "variant", "n", gone.alias("gone")).where("gone or n > 1"), "minhash-marks")
    marked = packed.drop("text").join(marks, ["doc_id", "variant"], "left")
    once = marked.where("not gone").groupBy("doc_id", "variant").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return marked.where("gone is null").select("row.*").unionByName(once.select("row.*"))

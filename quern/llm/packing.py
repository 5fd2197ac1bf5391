"""Best-two-fit packing of tokenised documents into fixed-size sequences.

A bin is filled greedily, largest document first; then its smallest document
is exchanged for the two unpacked documents that fill its place and the gap
most tightly, if they fill more. Only lengths matter, so the bins are laid out
on the histogram of piece lengths (at most ``capacity`` counts, whatever the
corpus): a bin's pattern is repeated as often as its lengths last, which gives
the same bins as going one by one. Pieces then take places by their rank among
pieces of equal length. Ranks come from salted windows with pre-counted
offsets, so no length, however common, is held in one task.

Defined results: a null or empty text is one piece of the end id alone; equal
lengths are interchangeable and ranked by (doc_id, piece); repeated rows are
packed each; an empty table gives no pieces; columns other than the id and the
text are ignored; a document longer than ``capacity`` ids is cut into pieces of
``capacity``, the last may be shorter. Texts of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, textscan, tokens

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenise(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, with ``keep_ids``, the ids themselves (little-endian uint32)."""
    schema = PIECES if keep_ids else T.StructType(PIECES.fields[:-1])
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())][: len(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            keys, texts = batch.column(0), batch.column(1)
            for i, j, flat, offsets in tokens.encoded(texts, path):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for k in range(j - i):
                    own = np.append(flat[offsets[k] : offsets[k + 1]], end_id).astype("<u4").tobytes()
                    for p, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        rows.append(i + k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                columns = [keys.take(pa.array(rows, pa.int64())), piece, start, length, crc, ids][: len(schema)]
                yield pa.record_batch([pa.array(c, t.type) if isinstance(c, list) else c for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def layout(counts: dict[int, int], capacity: int = 2048) -> tuple[np.ndarray, int]:
    """Places for ``counts[length]`` pieces of each length, and the number of bins.

    A row of places: length, first rank, ranks, first bin, copies a bin, offset
    in the bin. Rank r of that length goes to bin ``first bin + (r - first rank)
    // copies`` at ``offset + length * ((r - first rank) % copies)``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] = n
    below = np.zeros(capacity + 1, np.int64)  # the largest length at most i that is left, or 0

    def refresh() -> None:
        np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0), out=below)

    refresh()
    taken, places, bins = np.zeros(capacity + 1, np.int64), [], 0
    while below[capacity]:
        used: dict[int, int] = {}
        gap, at = capacity, int(below[capacity])
        asked: dict[int, int] = {}
        while at:
            n = min(gap // at, int(left[at]) - used.get(at, 0))
            if n:
                used[at] = used.get(at, 0) + n
                gap -= n * at
            at = int(below[min(gap, at - 1)])
        asked |= used
        if gap and sum(used.values()) > 1:
            least = min(used)
            used[least] -= 1
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            room, reach = gap + least, np.maximum.accumulate(np.where(free > 0, np.arange(capacity + 1), 0))
            a = np.arange(1, room)
            b = reach[np.minimum(room - a, a)]
            short = (b == a) & (free[a] < 2)
            b = np.where(short, reach[np.maximum(a - 1, 0)], b)
            total = np.where((free[a] > 0) & (b > 0) & (a + b <= room), a + b, 0)
            best = int(total.argmax()) if len(total) else 0
            if len(total) and total[best] > least:
                for length in (int(a[best]), int(b[best])):
                    used[length] = used.get(length, 0) + 1
            else:
                used[least] += 1
            used = {k: n for k, n in used.items() if n}
        # The next bin is the same as long as it finds all that this one looked at, taken or not.
        times, offset = min((int(left[k]) - max(n, asked.get(k, 0))) // n + 1 for k, n in used.items()), 0
        for length, n in sorted(used.items(), reverse=True):
            places.append((length, int(taken[length]), times * n, bins, n, offset))
            taken[length] += times * n
            left[length] -= times * n
            offset += n * length
        bins += times
        refresh()
    return np.array(sorted(places), np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = 2048, salt_rows: int | None = None) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more; a table that reads the same again) with sequence_id and offset."""
    spark = pieces.sparkSession
    sizes = pieces.groupBy("length").count().collect()  # at most one row a length
    if salt_rows is None:  # rows of equal length that are ranked together: a quarter of a task's share
        salt_rows = max(256, sum(r["count"] for r in sizes) // (4 * store.shuffle_partitions(spark)))
    places, _ = layout({r["length"]: r["count"] for r in sizes}, capacity)
    salts = [F.lit(1)]
    if big := {r["length"]: -(-r["count"] // salt_rows) for r in sizes if r["count"] > salt_rows}:
        known = F.create_map(*[F.lit(x) for kv in big.items() for x in kv])
        salts = [F.coalesce(known[F.col("length")], F.lit(1))]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), salts[0].cast("long")))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")
    shared = spark.sparkContext.broadcast(places)  # bounded by capacity alone
    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in pieces.schema]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        step = int(p[:, 1].max(initial=0)) + 1
        starts = p[:, 0].astype(object) * step + p[:, 1] if step > 1 << 50 else p[:, 0] * step + p[:, 1]
        for batch in textscan.in_turn(batches):
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            row = p[np.searchsorted(starts, length * step + np.minimum(rank, step - 1), "right") - 1]
            ahead = rank - row[:, 1]
            columns = [batch.column(c) for c in names]
            yield pa.record_batch([*columns, pa.array(row[:, 3] + ahead // row[:, 4]), pa.array(row[:, 5] + length * (ahead % row[:, 4]))], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "_rank").mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: a row for each piece."""
    return pack(store.saved(tokenise(docs, path, capacity, end_id, id_col, text_col, keep_ids), "pieces"), capacity)

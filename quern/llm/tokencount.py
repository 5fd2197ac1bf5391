"""Token counts of documents in flat token files, by a separator scan.

A token file is nothing but little-endian ids of fixed width, one document
after another, each closed by the end-of-document id; there is no index. The
scan reads files whole as binary rows, looks for the separator in blocks with
one vectorised comparison each, and keeps for a block the documents that end in
it and the ids left open behind the last separator. Documents that cross a
block's end are stitched by a prefix scan over the blocks (an open count runs
on until a block with a separator resets it), and the same scan runs over
files when the corpus is one stream cut into files.

Files are written with Spark's own text sink: a row is a whole file's ids, and
the line separator is the separator id's bytes, which closes its last document.
So any file system Spark knows will do, and writing survives lost executors. A
file takes documents until it has ``FILE_TOKENS`` ids, as the binary source
reads a file as one row; only a document that is longer has a longer file (of
its own, at most Spark's 2 GiB). Beside each token file stands a file with the
ids of its documents, so that counts can be told to them.

Defined results: an empty file has no documents; ids behind a file's last
separator are an unfinished document (``complete`` false), or go on in the next
file with ``stream=True``; adjacent separators are empty documents of one id
(the separator counts); a null or empty text is such a document; repeated texts,
and rows of one document id, are counted each; a null document id stays null;
columns other than the id and the text are ignored. Texts of any length are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store, textscan, tokens

#: Ids looked through at a time, and ids in a written file, about.
BLOCK_IDS, FILE_TOKENS = 1 << 16, 1 << 20
COUNTS = "file string, ordinal long, start long, n_tokens long, complete boolean"


def write(docs: DataFrame, to: str, path: str, end_id: int = 49407, width: int = 2, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> None:
    """Writes ``docs`` as flat token files under the folder ``to``/kind=0, their ids under ``to``/kind=1. The ids of ordinary text never include ``end_id``."""
    limit, dtype = 1 << 8 * width, f"<u{width}"
    if not 0 <= end_id < limit:
        raise ValueError("end_id does not fit the width")
    end = end_id.to_bytes(width, "little")
    schema = pa.schema([("kind", pa.int32()), ("seq", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        named: list[bytes] = []
        seq = size = 0

        def closed() -> pa.RecordBatch:
            values = [end.join(held), b"".join(named)]
            return pa.record_batch([pa.array([0, 1], pa.int32()), pa.array([seq, seq]), pa.array(values, pa.binary())], schema=schema)

        for batch in textscan.in_turn(batches):
            names = batch.column(0)
            ids = np.column_stack([names.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), names.fill_null(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)]) if len(batch) else None
            for i, _, flat, offsets in tokens.encoded(batch.column(1), path, ordinary=True):
                if len(flat) and (flat.max() >= limit or (flat == end_id).any()):
                    raise ValueError("an id is the separator or does not fit the width")
                raw = flat.astype(dtype)
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if held and size + b - a + 1 > file_tokens:
                        yield closed()
                        held, named, seq, size = [], [], seq + 1, 0
                    held.append(raw[a:b].tobytes())
                    named.append(ids[i + k].tobytes())
                    size += b - a + 1
        if held:
            yield closed()

    rows = docs.select(store.column(id_col).cast("long").alias("id"), store.column(text_col).cast("string").alias("text")).mapInArrow(run, "kind int, seq long, value binary")
    rows = rows.sortWithinPartitions("kind", "seq").select("kind", F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", end.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).partitionBy("kind").text(to)


def scan_ids(raw: bytes, end_id: int, width: int, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and sizes (with the separator) of the documents that end in ``raw``, and the ids left open."""
    if len(raw) % width:
        raise ValueError("a token file's size is not a multiple of the id's width")
    ids = np.frombuffer(raw, f"<u{width}")
    ends, counts, tails = [], [], []
    for at in range(0, len(ids), block):
        own = np.flatnonzero(ids[at : at + block] == end_id)
        ends.append(own + at)
        counts.append(len(own))
        tails.append(min(block, len(ids) - at) - (int(own[-1]) + 1 if len(own) else 0))
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    has, tail = np.array(counts) > 0, np.array(tails)
    run = np.cumsum(tail)  # prefix scan: what is open before a block, since the last block with a separator
    reset = np.maximum.accumulate(np.where(has, np.arange(len(has)), -1))
    open_after = run - np.where(reset >= 0, (run - tail)[np.maximum(reset, 0)], 0)
    carried = np.concatenate([[0], open_after[:-1]])
    end = np.concatenate(ends)
    first = np.cumsum(counts)[has] - np.array(counts)[has]  # the first end of each block that has one
    sizes = np.diff(end, prepend=-1)
    sizes[first] = end[first] - np.flatnonzero(has) * block + 1 + carried[has]
    return end - sizes + 1, sizes, int(open_after[-1])


def count(spark: SparkSession, folder: str, end_id: int = 49407, width: int = 2, stream: bool = False, block: int = BLOCK_IDS) -> DataFrame:
    """A row for each document of the token files in ``folder``: the file it ends in, its ordinal among those, start there, ids with the separator.

    With ``stream`` the files, in order of their paths, are one stream: a
    document's ``start`` is negative if it began in an earlier file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.where("kind = 0") if "kind" in files.columns else files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, size, left = scan_ids(raw.as_buffer(), end_id, width, block)
                n = len(start)
                if left:
                    start, size = np.append(start, len(raw.as_buffer()) // width - left), np.append(size, left)
                yield pa.record_batch([pa.array([name] * len(start), pa.string()), pa.array(np.arange(len(start))), pa.array(start), pa.array(size), pa.array(np.arange(len(start)) < n)], names=["file", "ordinal", "start", "n_tokens", "complete"])

    found = files.select("path", "content").mapInArrow(run, COUNTS)
    return _stitched(store.saved(found, "token-counts")) if stream else found


def _stitched(found: DataFrame) -> DataFrame:
    """The same scan over files: in ranges of paths first, on one small row a file, then over the ranges, on one row each."""
    ends = found.groupBy("file").agg(F.max("complete").cast("int").alias("closed"), F.sum(F.when(~F.col("complete"), F.col("n_tokens")).otherwise(0)).alias("tail"))
    ends = store.saved(ends.repartitionByRange("file").withColumn("run", F.spark_partition_id()), "token-files-ends")
    upto = (Window.unboundedPreceding, 0)
    inside = Window.partitionBy("run").orderBy("file")
    ends = ends.withColumn("group", F.sum("closed").over(inside.rowsBetween(*upto)))
    ends = ends.withColumn("open", F.sum("tail").over(Window.partitionBy("run", "group").orderBy("file").rowsBetween(*upto)))
    # What a range leaves open is the tail of its last group; with no separator in it, all it has, on top of what came before.
    runs = ends.groupBy("run").agg(F.max("closed").alias("closed"), F.max(F.struct("group", "open")).alias("last"), F.max("file").alias("to"))
    over = Window.orderBy("run")  # at most a row a partition
    runs = runs.withColumn("g", F.sum("closed").over(over.rowsBetween(*upto))).withColumn("left", F.sum("last.open").over(Window.partitionBy("g").orderBy("run").rowsBetween(*upto)))
    runs = runs.select("run", F.coalesce(F.lag("left").over(over), F.lit(0)).alias("carry"), (F.lead("run").over(over).isNull()).alias("final"), "to")
    ends = ends.join(F.broadcast(runs), "run").withColumn("open", F.col("open") + F.when(F.col("group") == 0, F.col("carry")).otherwise(0))
    ends = ends.select("file", "open", F.coalesce(F.lag("open").over(inside), "carry").alias("carried"), (F.col("final") & (F.col("file") == F.col("to"))).alias("last"))
    joined = found.join(ends, "file").where("complete or last")
    first = (F.col("ordinal") == 0) & F.col("complete")
    more = F.when(first, F.col("carried")).when(~F.col("complete"), F.col("open") - F.col("n_tokens")).otherwise(0)
    return joined.select("file", "ordinal", (F.col("start") - more).alias("start"), (F.col("n_tokens") + more).alias("n_tokens"), "complete")


def count_documents(spark: SparkSession, folder: str, end_id: int = 49407, width: int = 2) -> DataFrame:
    """``count`` of files that ``write`` has written, as one stream, with each document's doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.in_turn(batches):
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint8)
                own = own[: len(own) - width].reshape(-1, 9)  # the sink's separator stands behind the last
                ids = pa.array(np.ascontiguousarray(own[:, 1:]).view("<i8").ravel(), pa.int64(), mask=own[:, 0] == 0)
                yield pa.record_batch([pa.array([name] * len(own), pa.string()), pa.array(np.arange(len(own))), ids], names=["name", "nth", "doc_id"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    if "kind" not in files.columns:  # no document was written
        return spark.createDataFrame([], "doc_id long, " + COUNTS)
    ids = files.where("kind = 1").select("path", "content").mapInArrow(run, "name string, nth long, doc_id long")
    counts = count(spark, folder, end_id, width, stream=True)
    same = lambda c: F.concat_ws("-", F.regexp_extract(c, r"part-(\d+)-[^/]*$", 1), F.regexp_extract(c, r"\.c(\d+)[^/]*$", 1))
    return counts.withColumn("at", same("file")).join(ids.withColumn("by", same("name")), (F.col("at") == F.col("by")) & (F.col("ordinal") == F.col("nth"))).select("doc_id", *counts.columns)

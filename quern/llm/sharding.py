"""Shards by extendible hashing, in DataFrame operations only.

Rows are placed by the leading bits of a hash of their key. The directory is
built from byte sums of hash prefixes: a bucket that holds more than the limit
is split on one more bit, buckets that fit are left alone, until all fit. The
sums of one round come from one pass: rows are summed by a prefix of
``2 * shards`` cells and more, cells are summed again for each shorter prefix,
and a cell belongs to the shortest prefix that fits. What is still too large
at the round's last bit goes into the next round with further bits, so only
oversized buckets are looked at again.

The hash is 60 bits of the key's MD5, and behind these 60 bits of a row's own
number, so rows of one key, however many, also split. A bucket of one row that
is larger than the limit by itself can't be split and is marked ``oversize``.

Defined results: a null key hashes as an empty one; a null text has no bytes;
repeated rows are separate rows; an empty table has no shards; every other
column is carried along unless ``columns`` says otherwise, and comes back as it
was: outputs get underscores behind names that the table has.

The directory is a row for each cell. Up to ``BROADCAST_CELLS`` of them a round
are broadcast, and rows look their shard up where they are read; beyond that
rows and directory are joined by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BITS = 60
#: Bits beyond log2(bytes / limit) that a round looks at, and bits of later rounds.
SLACK, STEP = 4, 10
#: Cells of a round's directory that may be broadcast: some 100 bytes each.
BROADCAST_CELLS = 1 << 18
FOUND = {"shard": "string", "shard_bytes": "long", "shard_rows": "long"}


def key_bits(key: Column) -> Column:
    """60 bits of a string's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 15), 16, 10).cast("long")


def assign(docs: DataFrame, limit: int, key_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, broadcast_cells: int = BROADCAST_CELLS) -> DataFrame:
    """``docs`` (or its ``columns``), and behind them shard (the prefix, as bits), shard_bytes, shard_rows and oversize."""
    kept = docs if columns is None else docs.select(*map(store.column, columns))
    size = F.coalesce(F.octet_length(store.column(text_col).cast("string")), F.lit(0)).cast("long")
    row = F.struct(*[store.column(c).alias(c) for c in kept.columns])
    rows = store.saved(docs.select(row.alias("row"), size.alias("n"), key_bits(store.column(key_col).cast("string")).alias("key"), F.monotonically_increasing_id().alias("id")), "shard-rows")
    out = rows.select("row", "key", key_bits(F.col("id").cast("string")).alias("own"), F.lit("").alias("path"), *[F.lit(None).cast(t).alias(c) for c, t in FOUND.items()])
    keyed = rows.select("id", "n", "key", F.lit("").alias("path"))
    total = keyed.agg(F.sum("n"), F.count("*")).first()
    at, depth = 0, min(BITS, max(1, ((total[0] or 0) // limit).bit_length() + SLACK))
    while total[1]:
        here = F.shiftright(F.col("key"), BITS - at % BITS - depth).bitwiseAND((1 << depth) - 1)
        keyed = keyed.withColumn("key", key_bits(F.col("id").cast("string"))) if at == BITS else keyed
        cells = keyed.withColumn("cell", here).groupBy("path", "cell").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
        every = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("p", F.call_function("shiftright", F.col("cell"), (F.lit(depth) - F.col("d")).cast("int")))
        sums = every.groupBy("path", "d", "p").agg(F.sum("n").alias("bytes"), F.sum("r").alias("rows"))
        # A cell's bucket is the shortest prefix that fits; a single row always does.
        fits = sums.where((F.col("bytes") <= limit) | (F.col("rows") == 1)).select(F.col("path").alias("fpath"), F.col("d").alias("fd"), F.col("p").alias("fp"), "bytes", "rows")
        found = every.join(fits, (every["path"] == fits["fpath"]) & (every["d"] == fits["fd"]) & (every["p"] == fits["fp"]))
        found = found.groupBy("path", "cell").agg(F.min(F.struct("d", "p", "bytes", "rows")).alias("b"))
        shard = F.when(F.col("b").isNull(), F.lpad(F.bin("cell"), depth, "0")).when(F.col("b.d") > 0, F.lpad(F.bin("b.p"), F.col("b.d"), F.lit("0"))).otherwise("")
        directory = store.saved(cells.select("path", "cell").join(found, ["path", "cell"], "left").select("path", "cell", F.concat("path", shard).alias("shard"), F.col("b.bytes").alias("shard_bytes"), F.col("b.rows").alias("shard_rows")), "shard-directory")
        n_cells, n_open = directory.agg(F.count("*"), F.count(F.when(F.col("shard_rows").isNull(), 1))).first()
        # A row looks its cell up; rows whose shard is known have no path and meet nothing.
        level = directory.select(F.col("path").alias("lpath"), F.col("cell").alias("lcell"), *[F.col(c).alias("l" + c) for c in FOUND])
        level = F.broadcast(level) if n_cells <= broadcast_cells else level
        looked = out.withColumn("cell", F.when(F.col("path").isNotNull(), F.shiftright(F.col("key" if at < BITS else "own"), BITS - at % BITS - depth).bitwiseAND((1 << depth) - 1)))
        looked = looked.join(level, (F.col("path") == F.col("lpath")) & (F.col("cell") == F.col("lcell")), "left")
        done = F.col("lshard_rows").isNotNull()
        out = looked.select("row", "key", "own", F.when(~done, F.col("lshard")).alias("path"), *[F.coalesce(c, F.when(done, F.col("l" + c))).alias(c) for c in FOUND])
        if not n_open:
            break
        placed = keyed.withColumn("cell", here).join(directory.where("shard_rows is null").select("path", "cell", "shard"), ["path", "cell"])
        keyed = store.saved(placed.select("id", "n", "key", F.col("shard").alias("path")), "shard-oversize")
        at += depth
        if at >= 2 * BITS:
            raise RuntimeError("rows with equal numbers")  # row numbers are unique, so their hashes differ long before
        depth = min(STEP, BITS - at % BITS)
    outputs = store.names(kept, *FOUND, "oversize")
    values = [*map(F.col, FOUND), F.col("shard_bytes") > limit]
    return out.select("row.*", *[v.alias(n) for v, n in zip(values, outputs, strict=True)])

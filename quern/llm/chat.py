"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as ``assistant`` and all others as users with their names, and with a
mask that trains on the assistant's contents alone. Participants are the
distinct speakers; a system turn stays a system turn in every rendering.

A rendering is kept in parts of ``PART_TURNS`` turns, so that no conversation,
however long, is collected into one task: a part has its text, its place in the
whole rendering (``start``, in characters) and the masked spans. A dialogue of
ordinary length is one part. The rendering of a conversation is its parts in
order, joined by nothing.

A turn is rendered as ``<|im_start|>assistant\\n`` or ``<|im_start|>user name=X\\n``
or ``<|im_start|>system\\n``, the text, and ``<|im_end|>\\n``. A span [begin,
end) covers the assistant's text and its ``<|im_end|>``.

Defined results: turns are ordered by turn, then by speaker and text, nulls
first; a null text is empty; a null speaker is a participant named
``unknown``; a conversation of system turns alone has no participant and no
row; turns with a null conversation id are one conversation of that id;
repeated rows are repeated turns; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

PART_TURNS = 256
#: Parts of a conversation that a participant meets in one place.
JOIN_PARTS = 64
SYSTEM = "system"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, start, text, spans (relative to the part), n_masked: a row for each part of each rendering."""
    name = F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), name.alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Equal turns are counted, and distinct ones numbered in range partitions (nulls first), so a conversation of any size, and any turn number in it, is spread.
    order = ["conv_id", "turn", "speaker", "text"]
    dealt = store.saved(rows.groupBy(*order).agg(F.count("*").alias("n")).repartitionByRange(*order).withColumn("run", F.spark_partition_id()), "chat-turns")
    runs = dealt.groupBy("conv_id", "run").agg(F.sum("n").alias("in_run"))
    whole = Window.partitionBy("conv_id").orderBy("run")  # at most a row a partition
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), F.coalesce(F.sum("in_run").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "run").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r")))
    first = F.col("before") + F.col("within")
    rows = placed.select("conv_id", "speaker", "text", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("at")).withColumn("part", F.floor(F.col("at") / part_turns))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "speaker", "text"))).alias("turns"))
    # Participants meet the parts of their conversation in groups of JOIN_PARTS.
    sizes = dealt.groupBy("conv_id").agg(F.ceil(F.sum("n") / (part_turns * JOIN_PARTS)).cast("int").alias("groups")).withColumnRenamed("conv_id", "s")
    people = dealt.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct().join(sizes, F.col("c").eqNullSafe(F.col("s")))
    people = people.select("c", "perspective", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
    each = parts.join(people, parts["conv_id"].eqNullSafe(people["c"]) & (F.floor(F.col("part") / JOIN_PARTS) == F.col("g"))).select("conv_id", "perspective", "part", "turns")

    def head(t: Column) -> Column:
        user = F.concat(F.lit("<|im_start|>user name="), t["speaker"], F.lit("\n"))
        return F.when(t["speaker"] == SYSTEM, F.lit("<|im_start|>system\n")).when(t["speaker"] == F.col("perspective"), F.lit("<|im_start|>assistant\n")).otherwise(user)

    tail, end = "<|im_end|>\n", len("<|im_end|>")
    empty = F.struct(F.lit(0).alias("size"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["size"] + F.length(head(t))
        close = begin + F.length(t["text"]) + end
        span = F.struct(begin.cast("int").alias("begin"), close.cast("int").alias("end"))
        mine = t["speaker"] == F.col("perspective")
        return F.struct((close + 1).cast("int").alias("size"), F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    # Where a part starts is summed over sizes, without texts.
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(head(t)) + F.length(t["text"]) + len(tail))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("conv_id", "perspective", "part", size.alias("size")).withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)).cast("long"))
    starts = starts.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("k"), "start")
    masked = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["begin"])
    return each.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("k"))).select(
        "conv_id", "perspective", F.col("part").cast("int").alias("part"), F.size("turns").alias("n_turns"), "start",
        F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(tail))), "").alias("text"),
        F.aggregate("turns", empty, step)["spans"].alias("spans"),
    ).withColumn("n_masked", masked.cast("long"))

"""From raw texts to the panel: cleaning, ids, excerpts, flags, offices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..sources import shared
from . import quality, relational

#: Years kept, words below which a text is short.
YEARS, SHORT_WORDS = (1999, 2025), 300


def clean(raw: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Rows with a date in the years and a text that isn't blank; year and quarter added. Bad dates count as missing."""
    date = F.coalesce(F.try_to_date("date"), F.try_to_date(F.substring("date", 1, 10))) if dict(raw.dtypes)["date"] == "string" else F.to_date("date")
    rows = raw.withColumn("date", date).where(F.col("date").isNotNull() & F.year("date").between(*years) & ~text.is_blank(F.col("contents")))
    return rows.withColumns({"year": F.year("date"), "quarter": F.quarter("date")})


def placed(rows: DataFrame, by: list[Column], to: str = "place") -> DataFrame:
    """Places, from 1, in a total order: ranks inside range partitions, shifted by the counts before, so no task sees all rows.

    Rows that tie go by a hash of all their columns. The ranked partitions are
    saved, so that a lost executor can't rank ties anew.
    """
    spark = rows.sparkSession
    by = [*by, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    dealt = shared.saved(dealt.withColumn("_in", F.col("_in").bitwiseAND((1 << 33) - 1)), "places")
    counts = dict(dealt.groupBy("_part").count().collect())  # one row a partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    offsets = spark.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn(to, F.col("_in") + F.col("_before") + 1).drop("_part", "_in", "_before")


def numbered(rows: DataFrame, order: list[str], prefix: str = "doc_", width: int = 4, to: str = "speech_id") -> DataFrame:
    """Ids by place in a total order (nulls last)."""
    return placed(rows, [F.col(c).asc_nulls_last() for c in order], to).withColumn(to, F.format_string(f"{prefix}%0{width}d", F.col(to)))


def numbered_by_window(rows: DataFrame, order: list[str], prefix: str = "doc_", width: int = 4, to: str = "speech_id") -> DataFrame:
    """The same for a small table, in one window."""
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return rows.withColumn(to, F.format_string(f"{prefix}%0{width}d", F.row_number().over(w)))


def excerpts(rows: DataFrame, contents: str = "contents", n: int = lexicon.EXCERPT_WORDS) -> DataFrame:
    return rows.withColumns({"excerpt": text.excerpt(F.col(contents), n), "excerpt_words": F.least(text.word_count(F.col(contents)), F.lit(n))})


def build(corpus: DataFrame, signals: DataFrame, key: str = "speech_id", contents: str = "contents", n: int = lexicon.EXCERPT_WORDS, baseline: tuple[str, ...] = ()) -> DataFrame:
    """Texts with their codes, one to one, and all derived columns."""
    joined = relational.join_one_to_one(corpus, signals, [key])
    c = F.col(contents)
    words = text.word_count(c)
    out = joined.withColumns({
        "n_words": words, "log_words": F.when(words > 0, F.ln(words.cast("double"))), "truncated": words > n, "short": words < SHORT_WORDS,
        "n_speakers": F.when(text.is_blank(F.col("speakers")), 0).otherwise(F.regexp_count(F.col("speakers"), F.lit(",")) + 1),
        "yq": F.concat(F.year("date"), F.lit("Q"), F.quarter("date")), "ym": F.date_format("date", "yyyy-MM"), **text.language_flags(c),
    })
    for office, terms in lexicon.OFFICES.items():
        out = relational.office_holders(out, "date", terms, office)
        out = out.withColumn(f"is_{office}", F.coalesce(F.contains(F.col("speakers"), F.col(office)), F.lit(False)))
    return out.withColumn("baseline", quality.all_of([F.col("n_speakers") > 0, *[F.col(b) for b in baseline]]))


def speakers(panel: DataFrame, names: str = "speakers") -> DataFrame:
    """One row for each speaker of each text."""
    return panel.withColumn("speaker", F.explode(F.split(F.col(names), r"\s*,\s*"))).where(~text.is_blank(F.col("speaker")))


def keyword_candidates(rows: DataFrame, columns: list[str], pattern: str, years: tuple[int, int], order: list[str], n: int) -> DataFrame:
    """The first n texts, in order, of some years whose columns match a pattern."""
    hit = text.contains_pattern([F.col(c) for c in columns], pattern)
    return rows.where(F.col("year").between(*years) & hit).orderBy(*order).limit(n)

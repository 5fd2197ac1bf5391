"""Reproducible stratified samples, and the sheets they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quality

#: Seeds of the draws, least cells a sample must have, words a coder sees.
DRAW_SEED, CONTROL_SEED, LEAST_ATTENTION, LEAST_OUTLOOK, N_CONTROLS = 20260826, 20260827, 8, 4, 12


def eligible(panel: DataFrame, exclude: list[DataFrame], key: str, attention: list[str], baseline: Column, era: Column) -> DataFrame:
    """Baseline rows of no earlier round, with attention_count, era and stratum (era_n and the count)."""
    out = panel.where(baseline)
    for ids in exclude:
        out = out.join(ids.select(key).distinct(), key, "left_anti")
    count = sum((F.col(a) for a in attention[1:]), F.col(attention[0]))
    return out.withColumn("attention_count", count).withColumn("era", era).withColumn("stratum", F.concat("era", F.lit("_n"), F.col("attention_count").cast("string")))


def sizes(frame: DataFrame, stratum: str = "stratum") -> dict[str, int]:
    """Rows by stratum; strata are few."""
    return {r[0]: r[1] for r in frame.groupBy(stratum).count().collect()}


def allocate(available: dict[str, int], n: int, weights: dict[str, float] | None = None) -> dict[str, int]:
    """n rows over strata in proportion to size times weight: rounded half to even, at most what there is, then mended one at a time.

    A row that is missing goes to the stratum with the most left over; one too
    many comes from the one with the largest share. Ties go to the first name.
    """
    if n > sum(available.values()):
        raise ValueError(f"{n} rows asked for, {sum(available.values())} there")
    mass = {s: available[s] * (weights or {}).get(s, 1.0) for s in sorted(available)}
    total = sum(mass.values())
    out = {s: min(round(n * m / total), available[s]) if total else 0 for s, m in mass.items()}
    while (gap := n - sum(out.values())) != 0:
        room = {s: available[s] - k for s, k in out.items()} if gap > 0 else out
        best = max(room, key=room.__getitem__)
        out[best] += 1 if gap > 0 else -1
    return out


def draw(frame: DataFrame, counts: dict[str, int], key: str, seed: int = DRAW_SEED, stratum: str = "stratum") -> DataFrame:
    """Exactly so many rows of each stratum, by the order of a seeded hash of the key.

    Only as many rows of a stratum leave a task as are asked for.
    """
    quality.require(all(k >= 0 for k in counts.values()), "negative counts")
    asked = F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]) if counts else None
    if asked is None:
        return frame.limit(0)
    most = max(counts.values())
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    ranked = frame.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    return ranked.where(F.col("_k") <= F.coalesce(asked[F.col(stratum)], F.lit(0))).drop("_k")


def shuffled(frame: DataFrame, key: str, seed: int = DRAW_SEED) -> DataFrame:
    return frame.orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)


def replay_draw(ids: list, n: int, seed: int) -> list:
    """n of the ids without replacement, as numpy's generator draws them, in their own order: for small frames that must be drawn again exactly."""
    import numpy as np

    picked = np.random.default_rng(seed).choice(len(ids), size=n, replace=False)
    return [ids[i] for i in sorted(picked.tolist())]


def require_coverage(sample: DataFrame, attention: list[str], outlooks: list[str], least_attention: int = LEAST_ATTENTION, least_outlook: int = LEAST_OUTLOOK) -> DataFrame:
    """Each code has enough rows of each value that matters."""
    cells = {f"{v}={c}": (F.col(v) == c, least_attention) for v in attention for c in (0, 1)} | {f"{v}={c}": (F.col(v) == c, least_outlook) for v in outlooks for c in (-1, 1)}
    counts = sample.agg(*[F.count_if(c).alias(k) for k, (c, _) in cells.items()]).first()
    thin = {k: counts[k] for k, (_, least) in cells.items() if counts[k] < least}
    quality.require(not thin, f"too few rows: {thin}")
    return sample


def blind_sheet(sample: DataFrame, show: list[str], hide: list[str], blank: list[str]) -> tuple[DataFrame, DataFrame]:
    """The sheet a coder gets (columns to show, and blank ones to fill in), and the sealed key with the hidden codes."""
    leaked = (set(show) & set(hide)) | (set(show) & set(blank))
    quality.require(not leaked, f"columns would leak into the sheet: {sorted(leaked)}")
    sheet = sample.select(*show, *[F.lit(None).cast("string").alias(b) for b in blank])
    return sheet, sample.select(*show[:1], *hide)


def full_text_sheet(sample: DataFrame, contents: str, seen: int, show: list[str], blank: list[str]) -> DataFrame:
    from ..functions import text

    words = text.word_count(F.col(contents))
    return sample.select(*show, words.alias("words_full"), F.least(words, F.lit(seen)).alias("words_seen"), (words > seen).alias("truncated"), F.col(contents), *[F.lit(None).cast("string").alias(b) for b in blank])


def treated_and_controls(frame: DataFrame, treated: Column, key: str, n: int = N_CONTROLS, seed: int = CONTROL_SEED) -> DataFrame:
    """All treated rows and n controls, in a fixed random order."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    picked = frame.where(~treated).orderBy(order, key).limit(n)
    return frame.where(treated).withColumn("group", F.lit("treated")).unionByName(picked.withColumn("group", F.lit("control"))).orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)

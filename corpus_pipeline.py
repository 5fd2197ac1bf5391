"""The corpus pipeline: each stage calls one operator on all its predecessor kept.

Stages take (spark, docs, sf_dir) and return the columns of documents, but for
the last, which returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontam, langid, linededup, minhash, packing, queries, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told (``und``), or that are surely no text of even the likeliest one."""
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    found = langid.identify(docs, langid.train(docs.where(~held)))
    named, _, _, strange = map(store.column, found.columns[len(docs.columns) :])
    return found.where((named != "und") & ~strange).select(*map(store.column, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts stays; rows without an id stay as they are."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer_file(), queries.CAPACITY, keep_ids=False)


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.saved(stage(spark, docs, sf_dir), "pipeline-" + name.split(" ")[0].lower())
    return docs

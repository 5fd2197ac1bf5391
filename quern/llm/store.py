"""Intermediate tables in the folder that the whole cluster shares, and names that clash with none.

An operator's result reads what the operator saved, so nothing is deleted while
it may still be read: call ``clear`` once results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one of our own only where that is unset (tests, one machine)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quern-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has saved. Results that still read them must have been written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(name: str) -> Column:
    """A column by its exact name, dots and backticks and all."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, text_col: str, **more: Column) -> DataFrame:
    """``docs`` as columns that clash with none of its own: row (all but the text), text, and any more."""
    others = [column(c).alias(c) for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others or [F.lit(0).alias("_")]).alias("row"), column(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])


def unpacked(done: DataFrame, docs: DataFrame, text_col: str, *outputs: str) -> DataFrame:
    """The columns of ``docs`` again, in order, and behind them the outputs. An output whose name ``docs`` has gets underscores behind it."""
    own = [F.col("text").alias(c) if c == text_col else F.col("row." + quoted(c)).alias(c) for c in docs.columns]
    return done.select(*own, *[F.col(o).alias(n) for o, n in zip(outputs, names(docs, *outputs), strict=True)])


def names(docs: DataFrame, *outputs: str) -> list[str]:
    """Names for ``outputs`` that ``docs`` doesn't have, whatever the case of letters."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in outputs:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

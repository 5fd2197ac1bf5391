"""Registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


#: Orders as coded texts: customer speaks, priority is attention, status the outlook; a second coder differs by key.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
PANEL_SQL = """(SELECT *, att * dir AS outl, CASE WHEN o_orderkey % 7 = 0 THEN 1 - att ELSE att END AS att_b,
  CASE WHEN o_orderkey % 7 = 0 THEN (1 - att) * dir WHEN o_orderkey % 5 = 0 THEN -(att * dir) WHEN o_orderkey % 11 = 0 THEN 0 ELSE att * dir END AS outl_b
 FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate::DATE AS d,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 1 ELSE 0 END AS att,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END AS dir FROM orders))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("d"), F.col("o_orderpriority").isin(*PRIORITIES).cast("int").alias("att"), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", -1).otherwise(0).alias("dir"))
    key = F.col("o_orderkey")
    flip = key % 7 == 0
    own = F.col("att") * F.col("dir")
    return o.withColumns({
        "outl": own, "att_b": F.when(flip, 1 - F.col("att")).otherwise(F.col("att")),
        "outl_b": F.when(flip, (1 - F.col("att")) * F.col("dir")).when(key % 5 == 0, -own).when(key % 11 == 0, 0).otherwise(own),
    })


def _register() -> None:
    from . import q_agreement, q_gates, q_kernels, q_measures, q_ordered, q_points, q_relational, q_text  # noqa: F401


_register()

"""Reading: delimited text, landed series, JSON, templates, and a data source for remote series."""

from __future__ import annotations

import csv
import io
import json
import os
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import schemas

TIMEOUT_SECONDS = 60


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Fields between bars, no quoting, UTF-8."""
    return spark.read.csv(path, sep="|", header=True, quote="", schema=schemas.RAW_CORPUS, encoding="UTF-8")


def table_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with header and quoted texts that may hold line breaks."""
    out = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', quote='"', dateFormat="yyyy-MM-dd", enforceSchema=False)
    return out.select(*columns) if columns else out


def as_int(df: DataFrame, names: list[str]) -> DataFrame:
    """Codes that were stored as 1.0."""
    return df.withColumns({n: F.col(n).cast("int") for n in names})


def series_csv(spark: SparkSession, path: str) -> DataFrame:
    """A landed series: exactly a period and a value."""
    out = spark.read.csv(path, header=True, schema=schemas.SERIES, enforceSchema=False)
    if out.limit(1).count() == 0:
        raise ValueError(f"{path} has no observations")
    return out


def period_date(period: str = "TIME_PERIOD"):
    """The first day of yyyy, yyyy-MM, yyyy-Qq or yyyyQq, or the day itself."""
    c = F.col(period)
    quarter = F.regexp_extract(c, r"^(\d{4})-?Q([1-4])$", 2)
    year = F.regexp_extract(c, r"^(\d{4})", 1)
    return (
        F.when(quarter != "", F.try_to_date(F.concat(year, F.lit("-"), F.lpad((quarter.cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01"))))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(c, F.lit("-01"))))
        .when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-01-01"))))
        .otherwise(F.try_to_date(c))
    )


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST")


def error_rates(spark: SparkSession, path: str) -> DataFrame:
    """variable and its rates."""
    return json_document(spark, path, schemas.ERROR_RATES).select(F.explode("variables").alias("variable", "r")).select("variable", "r.*")


def template(text: str, columns: dict[str, str], null_as_empty: bool = True):
    """A text with {names} filled from columns; a brace that names no column stays."""
    out = F.lit(text)
    for name, column in columns.items():
        value = F.col(column).cast("string")
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")) if null_as_empty else F.coalesce(value, F.lit("None")))
    return out


def fetch(url: str, to: str, get: Callable[[str], bytes] | None = None) -> str:
    """The file ``to``, fetched if it isn't there yet; so a vintage stays pinned."""
    if not os.path.exists(to):
        body = (get or _get)(url)
        os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
        with open(to + ".part", "wb") as f:
            f.write(body)
        os.replace(to + ".part", to)
    return to


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT_SECONDS) as r:
        return r.read()


def fetch_all(urls: dict[str, str], folder: str, get: Callable[[str], bytes] | None = None) -> dict[str, str]:
    return {name: fetch(url, f"{folder}/{name}.csv", get) for name, url in urls.items()}


def read_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class _Series(InputPartition):
    def __init__(self, name: str, url: str):
        super().__init__(name)
        self.name, self.url = name, url


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options.get("url", "")
        self.names = [n.strip() for n in options.get("series", "").split(",") if n.strip()]

    def partitions(self) -> list[InputPartition]:
        """A task a series."""
        return [_Series(n, self.base.replace("{series}", n)) for n in self.names]

    def read(self, partition: _Series) -> Iterator[tuple]:
        rows = csv.DictReader(io.StringIO(_get(partition.url).decode("utf-8")))
        if not {"TIME_PERIOD", "OBS_VALUE"} <= set(rows.fieldnames or []):
            raise ValueError(f"{partition.name}: no period or value column")
        found = False
        for r in rows:
            found = True
            yield partition.name, r["TIME_PERIOD"], float(r["OBS_VALUE"]) if r["OBS_VALUE"] else None
        if not found:
            raise ValueError(f"{partition.name}: no observations")


class SeriesSource(DataSource):
    """``spark.read.format("series").option("url", "https://.../{series}?format=csv").option("series", "a,b")``; http, https and file addresses."""

    @classmethod
    def name(cls) -> str:
        return "series"

    def schema(self) -> str:
        return "series string, TIME_PERIOD string, OBS_VALUE double"

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SeriesSource)

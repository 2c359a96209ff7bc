"""Catalog files in and result files out."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.catalog import ColumnMap, build_records


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, empty cells as empty strings. Read as UTF-8; files that are not are read again as Latin-1."""

    def read(encoding: str) -> DataFrame:
        reader = spark.read.options(header=True, inferSchema=False, multiLine=True, escape='"', quote='"', encoding=encoding, nullValue="\u0000", emptyValue="")
        return reader.csv(path).fillna("")

    # lines of text are read as the bytes they are, so bytes that are no UTF-8 are told from a replacement character that a file really holds
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return read("UTF-8" if broken.isEmpty() else "ISO-8859-1")


@dataclass(frozen=True)
class Benchmark:
    """Where two catalogs and their gold pairs lie, and how their columns are called."""

    left: str
    right: str
    gold: str
    gold_left: str
    gold_right: str
    left_columns: ColumnMap
    right_columns: ColumnMap


#: two public benchmarks by the names of their columns
BENCHMARKS = {
    "abt-buy": Benchmark("Abt.csv", "Buy.csv", "abt_buy_perfectMapping.csv", "idAbt", "idBuy", ColumnMap("id", "name", "description", price="price", default_currency="USD"), ColumnMap("id", "name", "description", "manufacturer", price="price", default_currency="USD")),
    "amazon-google": Benchmark("Amazon.csv", "GoogleProducts.csv", "Amzon_GoogleProducts_perfectMapping.csv", "idAmazon", "idGoogleBase", ColumnMap("id", "title", "description", "manufacturer", price="price", default_currency="USD"), ColumnMap("id", "name", "description", "manufacturer", price="price", default_currency="USD")),
}


def load_benchmark(spark: SparkSession, folder: str, spec: Benchmark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(left records, right records, distinct gold pairs)."""
    left = build_records(read_csv(spark, f"{folder}/{spec.left}"), spec.left_columns, "A")
    right = build_records(read_csv(spark, f"{folder}/{spec.right}"), spec.right_columns, "B")
    gold = read_csv(spark, f"{folder}/{spec.gold}").select(F.col(spec.gold_left).alias("left_rid"), F.col(spec.gold_right).alias("right_rid")).distinct()
    return left, right, gold


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, for a record of where data came from."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_json(rows: Iterable[dict] | dict, path: str) -> None:
    """A small result (thresholds, counts) as one JSON file."""
    with open(path, "w") as f:
        json.dump(rows if isinstance(rows, dict) else list(rows), f, indent=2, sort_keys=True)


class AnswerCache:
    """A parquet table of answers (key, response, latency, ts): later rows win, appending never rewrites."""

    SCHEMA = "key string, response string, latency double, ts timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        """The latest answer for each key."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return rows.groupBy("key").agg(F.max_by("response", "ts").alias("response"), F.max_by("latency", "ts").alias("latency"), F.max("ts").alias("ts"))

    def append(self, responses: DataFrame) -> None:
        fresh = responses.filter("not cached and response is not null").dropDuplicates(["key"])
        fresh.select("key", "response", "latency", F.current_timestamp().alias("ts")).write.mode("append").parquet(self.path)

    def size(self) -> int:
        return self.read().count()

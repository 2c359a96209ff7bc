"""Reading the tables that queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RECORD_TABLES = ("catalog_left", "catalog_right", "listings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The three record tables, one after the other."""
    parts = [table(spark, sf_dir, t).select(*columns) for t in RECORD_TABLES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

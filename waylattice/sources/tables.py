"""Named parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Reads ``<folder>/<name>.parquet`` (a file or a directory of parts)."""
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")

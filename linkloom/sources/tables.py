"""The engine's tables on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder: a file or a folder of files called ``<name>.parquet``."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")

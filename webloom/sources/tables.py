"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``: a parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")

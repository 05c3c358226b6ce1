"""Readers for the table folder a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

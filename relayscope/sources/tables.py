"""Stored tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relayscope.session import reach


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, a file or a folder of files."""
    return reach(spark).read.parquet(f"{folder}/{name}.parquet")

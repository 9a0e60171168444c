"""Parquet tables of a data folder, read by Spark's own reader so that any file system works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; a plain file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

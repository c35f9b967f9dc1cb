"""Loaders for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned and filters pushed by the caller's plan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

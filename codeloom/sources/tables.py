"""Parquet tables of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory; columns are pruned by what the query selects."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

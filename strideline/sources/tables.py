"""Named input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

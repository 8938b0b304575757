"""Access to the star-schema and corpus tables that live as Parquet under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; a lazy scan, so filters and column choices reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

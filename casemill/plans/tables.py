"""Readers for the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, by any path that Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

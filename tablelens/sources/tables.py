"""Reading the provided parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tablelens.functions.columns import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of one table; NaN becomes null (it counts as missing)."""
    return nan_to_null(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")))

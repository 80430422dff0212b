"""Sinks: profile store (K01) and findings store (K02). The fitted pipeline
artifact (K03) is the standard ``PipelineModel`` writer, see ``operators.features``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_profile(profile: DataFrame, path: str, dataset: str) -> None:
    """Write the per-column profile as parquet, one folder per dataset (overwrite)."""
    (profile.withColumn("dataset", F.lit(dataset))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("dataset").parquet(path))


def append_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """Append a run's findings to the findings table (parquet, partitioned by run)."""
    (findings.withColumn("run_id", F.lit(run_id))
     .write.mode("append").partitionBy("run_id").parquet(path))

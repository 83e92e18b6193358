"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in (path := env.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = f"{root}:{path}".rstrip(":")
    return spark

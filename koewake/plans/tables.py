"""Reading the input tables of a directory of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``sf_dir``; only ``columns`` of it where any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df

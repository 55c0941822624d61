"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load_table(spark: SparkSession, source: str, name: str | None = None) -> DataFrame:
    """A catalog table (`source` alone) or `{source}/{name}.parquet`.

    The scan stays lazy, so later projections and filters reach the files.
    """
    if name is None:
        return spark.table(source)
    return spark.read.parquet(f"{source}/{name}.parquet")

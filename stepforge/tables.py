"""Reading of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` under ``root``, with only ``columns`` if any are given.

    Columns are chosen right after the scan, so clashing extra columns of the
    input never reach an operator.
    """
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df

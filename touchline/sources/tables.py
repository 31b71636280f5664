"""Readers for the parquet tables of one data folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Scan ``folder/name.parquet``, a file or a folder of part files.

    With ``columns`` only these are read, so the scan is pruned even where a
    Python stage follows that Catalyst can't see through.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns is not None else df


def register(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Register every named table as a temporary view."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)

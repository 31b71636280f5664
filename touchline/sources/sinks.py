"""Writers: tables, quarantine, CSV, JSON and master write-back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a managed table."""
    df.write.mode("overwrite").saveAsTable(name)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_split(matched: DataFrame, quarantine: DataFrame, folder: str, source: str) -> None:
    """Staging and quarantine of one source; an empty one keeps its columns."""
    write_parquet(matched, f"{folder}/staging/matched_{source}")
    write_parquet(quarantine, f"{folder}/quarantine/unmatched_{source}")


def write_csv(df: DataFrame, path: str, order: Sequence[Column], single: bool = False) -> None:
    """CSV with a header in a total order.

    Range partitions keep the order over several files; ``single`` makes one file
    and is for reports of a bounded size.
    """
    placed = df.orderBy(*order)
    (placed.coalesce(1) if single else placed).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def as_json(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """One JSON text a row, ``json``, in order."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_report(df: DataFrame, folder: str, name: str, order: Sequence[Column]) -> dict[str, object]:
    """CSV and JSON lines of a report, and a summary of it."""
    write_csv(df, f"{folder}/{name}.csv", order, single=True)
    as_json(df, order).coalesce(1).write.mode("overwrite").text(f"{folder}/{name}.json")
    return {"name": name, "rows": df.count(), "columns": df.columns}


def write_back(master: DataFrame, matches: DataFrame, key: str, mapping: dict[str, str], today: str, stamp: str, path: str) -> DataFrame:
    """Matched source values into the master; only changed rows get the stamp.

    ``mapping`` names the master's column of each source column. Of several
    values for an entity the least counts. The written master is returned.
    """
    from touchline.operators.entity import fill_fields

    updates = matches.groupBy(key).agg(*[F.min(s).alias(m) for s, m in mapping.items()])
    new = fill_fields(master, updates, key, list(mapping.values()), today=today, stamp=stamp)
    write_parquet(new, path)
    return new.sparkSession.read.parquet(path)


def databases(spark: SparkSession, names: Sequence[str] = ("raw", "curated", "staging", "quarantine")) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")

"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from strataloom.operators.current import current_rows, file_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(spark: SparkSession, sf_dir: str, name: str, keys: list[str], payload: list[Column | str]) -> DataFrame:
    """The current rows of a table of deliveries."""
    return current_rows(table(spark, sf_dir, name), keys, payload, row_id=file_row())

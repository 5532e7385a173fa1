"""The two kinds of text items of the project: documents' content and chunks' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.current import current_rows, file_row
from strataloom.plans.tables import table


def delivered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries: item_kind, item_id, text, section_path (null for documents), arrived_at, row_id."""
    documents = table(spark, sf_dir, "norm_documents").select(
        F.lit("document").alias("item_kind"), F.col("document_id").alias("item_id"), F.col("content").alias("text"), F.lit(None).cast("array<string>").alias("section_path"), "arrived_at", file_row().alias("row_id")
    )
    chunks = table(spark, sf_dir, "knowledge_chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text", "section_path", "arrived_at", file_row().alias("row_id"))
    return documents.unionByName(chunks)


def current_items(items: DataFrame, payload: list[Column | str], where: Column | None = None) -> DataFrame:
    """Current rows by kind and id; ``where``: those of them that it holds for, found before anything is shuffled."""
    return current_rows(items, ["item_kind", "item_id"], payload, row_id=F.col("row_id"), where=where)

"""All queries of the core, by name, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans import audit_plans, corpus_plans, ingest_plans, retrieval_plans

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {**corpus_plans.QUERIES, **ingest_plans.QUERIES, **retrieval_plans.QUERIES, **audit_plans.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ALL["bm25_topk"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}

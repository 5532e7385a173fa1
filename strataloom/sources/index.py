"""The chunk index as a table: rows, upsert, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The greatest length of the columns that a search can be narrowed by.
FILTER_LENGTHS = {"document_id": 128, "domain": 128, "project": 128, "classification": 64, "source_type": 64, "provider": 128, "source_id": 256}
_COLUMNS = ["chunk_id", "document_id", "text", "vector", "tenant_id", "domain", "project", "classification", "source_type", "provider", "source_id", "metadata_json"]
INDEX_SCHEMA = T.StructType(
    [T.StructField(c, T.ArrayType(T.FloatType()) if c == "vector" else T.StringType(), metadata={"filter_length": FILTER_LENGTHS[c]} if c in FILTER_LENGTHS else {}) for c in _COLUMNS]
)


def index_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as index rows without their vectors: nulls become the defaults, what isn't a column goes to metadata_json."""
    nested = F.to_json(F.struct("title", "chunk_index", F.coalesce("section_path", F.expr("cast(array() as array<string>)")).alias("section_path"), "token_count"))
    return chunks.select(
        "chunk_id", "document_id", "text", F.coalesce("security.tenant_id", F.lit("default")).alias("tenant_id"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("project", F.lit("")).alias("project"),
        F.coalesce("security.classification", F.lit("internal")).alias("classification"), F.coalesce("source.source_type", F.lit("")).alias("source_type"), F.coalesce("source.provider", F.lit("")).alias("provider"),
        F.coalesce("source.source_id", F.lit("")).alias("source_id"), nested.alias("metadata_json"),
    )


def upsert(target: DataFrame, new: DataFrame, key: str = "chunk_id", replace: str | None = None) -> DataFrame:
    """``target`` with the rows of ``new``, which win. ``replace``: also drop all older rows that share this column's value with a new one."""
    kept = target.join(new.select(key).distinct(), key, "left_anti")
    if replace is not None:
        kept = kept.join(new.select(replace).distinct(), replace, "left_anti")
    return kept.select(*target.columns).unionByName(new.select(*target.columns))


def check_columns(df: DataFrame, expected: T.StructType = INDEX_SCHEMA) -> None:
    """An existing index must have every column with its type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in expected.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")

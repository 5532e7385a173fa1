"""Converted files as normalised documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import file_extension, first_nonempty, strip

# Provider by extension.
PROVIDERS = {".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".docx": "docx"}


def heading_title(content: Column) -> Column:
    """The first Markdown heading that isn't empty, without its marks; null without one."""
    return F.nullif(strip(F.regexp_extract(content, r"(?m)^[ \t]*#{1,6}[ \t]+([^\r\n]*?[^\s#][^\r\n]*?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def normalize_documents(converted: DataFrame, raw: DataFrame) -> DataFrame:
    """Document rows of converted files (path, content, error) and their raw files (path, raw_sha256, raw_size_bytes). Failed ones are left out.

    The id comes from the raw bytes and the kind, so copies of one file share it.
    """
    rows = converted.where("error is null").select("path", "content").join(raw.select("path", "raw_sha256", "raw_size_bytes"), "path")
    extension = file_extension(F.col("path"))
    provider = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv]), extension), F.lit("file"))
    filename = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return rows.select(
        F.concat(F.lit("document:"), provider, F.lit(":"), F.substring("raw_sha256", 1, 24)).alias("document_id"), first_nonempty(heading_title(F.col("content")), stem).alias("title"), "content", F.sha2("content", 256).alias("content_hash"),
        F.struct(F.lit("document").alias("source_type"), provider.alias("provider"), F.col("path").alias("uri"), F.substring("raw_sha256", 1, 24).alias("source_id")).alias("source"),
        F.to_json(F.struct(filename.alias("filename"), extension.alias("extension"), "raw_sha256", "raw_size_bytes")).alias("metadata"),
    )

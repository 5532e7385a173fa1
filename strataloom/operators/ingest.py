"""The ingest run: files to documents, scan, chunks, vectors and index rows, with what became of every file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import chat_export, chunking, embedding, security
from strataloom.scratch import materialize
from strataloom.sources import documents, files, index, raw_store

_SECURITY = "struct<tenant_id: string, classification: string, owner_id: string, allowed_users: array<string>, allowed_groups: array<string>, contains_sensitive_data: boolean, sensitive_categories: array<string>>"
_SOURCE = "struct<source_type: string, provider: string, uri: string, source_id: string>"


@dataclass(frozen=True)
class IngestConfig:
    """``tenant``, ``classification``, ``domain`` and ``project`` are given to every document. ``strict``: a file that fails is an error of the run, not a row."""

    tenant: str = "default"
    classification: str = "internal"
    domain: str | None = None
    project: str | None = None
    policy: security.Policy = field(default_factory=security.Policy)
    chunking: chunking.ChunkingConfig = field(default_factory=chunking.ChunkingConfig)
    strict: bool = False


@dataclass(frozen=True)
class Ingested:
    """``documents`` after the scan, blocked ones too; ``chunks`` of the accepted; ``rows`` of the index, with vectors where a model was given."""

    documents: DataFrame
    chunks: DataFrame
    rows: DataFrame


def ingest_documents(docs: DataFrame, turns: DataFrame | None = None, config: IngestConfig = IngestConfig(), model: Callable[[], embedding.Model] | None = None, vectors: embedding.EmbeddingConfig = embedding.EmbeddingConfig()) -> Ingested:
    """Scan, split blocked from accepted, chunk, embed. ``docs``: document_id, title, content, source, metadata, security and what else chunks take over.

    A blocked document appears in ``documents`` only, with its decision. Where
    something is redacted, the chunks are of the redacted text, and conversations are
    chunked by it too, as their turns aren't redacted one by one. ``turns``:
    document_id, turn_pos, speaker, text.
    """
    have = docs.withColumns({c: F.lit(None).cast("string") for c in ("author", "metadata", "source_metadata") if c not in docs.columns})
    scanned = materialize(security.scan(have, config.policy), "scanned")
    accepted = scanned.where("decision <> 'block'").withColumn("source_type", F.col("source.source_type"))
    if turns is None:
        chunks = chunking.chunk_documents(accepted, config=config.chunking)
    else:
        spoken = turns.join(accepted.where("not redacted").select("document_id"), "document_id", "left_semi")
        chunks = chunking.chunk_all(accepted, spoken, conv="document_id", config=config.chunking)
    chunks = materialize(chunking.inherited(chunks, accepted), "chunks")
    rows = index.index_rows(chunks)
    if model is not None:
        rows = embedding.embed(rows, F.col("text"), model, vectors)
    return Ingested(scanned, chunks, rows)


def file_documents(spark: SparkSession, paths: str | list[str], config: IngestConfig, convert: Callable[[str, bytes], str] | None = None, raw_table: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, documents, turns) of files and folders. ``files``: path, kind, raw_key, error and the stage it happened in; with ``raw_table`` each file is stored there once."""
    read = files.read_binary(spark, paths, recursive=True)
    key = raw_store.raw_key(F.lit(config.tenant), F.coalesce("kind", F.lit("source")), F.col("raw_sha256"), F.substring_index("path", "/", -1))
    read = read.withColumn("raw_key", key)
    if raw_table is not None:
        raw_store.put_once(spark, read.select("raw_key", "raw_sha256", "raw_size_bytes", "content"), raw_table)
    converted = materialize(files.read_documents(read.where("kind = 'document'"), convert), "converted")
    said = materialize(files.read_conversations(read.where("kind = 'chat'"), strict=False), "conversations")
    written = documents.normalize_documents(converted, read)
    talks = chat_export.normalize(said.where("error is null"), keep=("path",))
    source = F.struct(F.lit("conversation").alias("source_type"), F.lit("chatgpt").alias("provider"), F.col("path").alias("uri"), F.substring_index("document_id", ":", -1).alias("source_id"))
    common = ["document_id", "title", "content", "content_hash", "source", "metadata", "path"]
    from_talks = talks.select("document_id", "title", "content", "content_hash", source.cast(_SOURCE).alias("source"), F.to_json(F.struct("user_turns", "assistant_turns", "mapping_nodes", "inactive_nodes", "diagnostics", "fields")).alias("metadata"), "path")
    docs = written.withColumn("path", F.col("source.uri")).withColumn("source", F.col("source").cast(_SOURCE)).select(*common).unionByName(from_talks.select(*common))
    # Copies of one file are one document, of the first path.
    docs = docs.groupBy("document_id").agg(F.min_by(F.struct(*common[1:]), "path").alias("d")).select("document_id", "d.*")
    given = F.struct(
        F.lit(config.tenant).alias("tenant_id"), F.lit(config.classification).alias("classification"), F.lit(None).cast("string").alias("owner_id"), F.array().cast("array<string>").alias("allowed_users"),
        F.array().cast("array<string>").alias("allowed_groups"), F.lit(False).alias("contains_sensitive_data"), F.array().cast("array<string>").alias("sensitive_categories"),
    )
    docs = docs.withColumns({"domain": F.lit(config.domain).cast("string"), "project": F.lit(config.project).cast("string"), "security": given.cast(_SECURITY)})
    turns = talks.select("document_id", F.posexplode("turns").alias("turn_pos", "t")).select("document_id", F.col("turn_pos").cast("long").alias("turn_pos"), F.col("t.role").alias("speaker"), F.col("t.text").alias("text"))
    failed = converted.where("error is not null").select("path", "error", F.lit("convert").alias("stage")).unionByName(said.where("error is not null").select("path", "error", F.lit("parse").alias("stage")))
    failed = failed.groupBy("path").agg(F.min("error").alias("error"), F.min("stage").alias("stage"))
    unknown = F.col("kind").isNull()
    told = read.select("path", "kind", "raw_key").join(failed, "path", "left")
    told = told.withColumns({"stage": F.when(unknown, "kind").otherwise(F.col("stage")), "error": F.when(unknown, "no known kind of file").otherwise(F.col("error"))})
    return told, docs, turns


def outcomes(told: DataFrame, done: Ingested) -> DataFrame:
    """Of each file: path, kind, raw_key, documents, accepted, blocked, chunks, indexed, stage and error (null where nothing failed)."""
    docs = done.documents.select("path", "document_id", "decision")
    chunks = done.chunks.groupBy("document_id").agg(F.count("*").alias("n"))
    indexed = done.rows.groupBy("document_id").agg(F.count("*").alias("m"))
    each = docs.join(chunks, "document_id", "left").join(indexed, "document_id", "left").groupBy("path").agg(
        F.count("*").alias("documents"), F.count_if(F.col("decision") != "block").alias("accepted"), F.count_if(F.col("decision") == "block").alias("blocked"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("m"), F.lit(0)).alias("indexed")
    )
    return told.join(each, "path", "left").na.fill(0, ["documents", "accepted", "blocked", "chunks", "indexed"])


def ingest_files(spark: SparkSession, paths: str | list[str], config: IngestConfig = IngestConfig(), convert: Callable[[str, bytes], str] | None = None, model: Callable[[], embedding.Model] | None = None, vectors: embedding.EmbeddingConfig = embedding.EmbeddingConfig(), raw_table: str | None = None) -> tuple[Ingested, DataFrame]:
    """The whole run: what was ingested, and the outcomes of all files by path. No file at all is an error.

    Rows of the index are one for each chunk, or the run fails. To put them into an index see ``index.upsert``.
    """
    told, docs, turns = file_documents(spark, paths, config, convert, raw_table)
    told = materialize(told, "files")
    if told.isEmpty():
        raise ValueError("there is no file to ingest")
    if config.strict and (bad := told.where("error is not null").orderBy("path").first()):
        raise ValueError(f"{bad.path}: {bad.stage}: {bad.error}")
    done = ingest_documents(docs, turns, config, model, vectors)
    done = Ingested(done.documents, done.chunks, materialize(done.rows, "rows"))
    if done.rows.count() != done.chunks.count():
        raise ValueError("not every chunk has one index row")
    return done, outcomes(told, done).orderBy("path")

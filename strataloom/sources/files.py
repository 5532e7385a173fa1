"""Reading raw files: kinds by extension, JSON and ZIP chat exports, documents, session logs."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import file_extension
from strataloom.operators.ranking import positions

# Fixed values.
KINDS = {".json": "chat", ".zip": "chat", ".pdf": "document", ".docx": "document", ".md": "document", ".markdown": "document"}
CONVERSATION_FILE = r"(?i)(^|/)conversations([-_]\d+)?\.json$"
MAX_ZIP_DEPTH = 3


def source_kind(path: Column, requested: str = "auto") -> Column:
    """chat or document by extension; null for an unknown one and for one that contradicts ``requested``."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), file_extension(path))
    return kind if requested == "auto" else F.when(kind == requested, kind)


def read_binary(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """path, content, raw_sha256, raw_size_bytes, kind of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return files.select("path", "content", F.sha2("content", 256).alias("raw_sha256"), F.length("content").cast("long").alias("raw_size_bytes"), source_kind(F.col("path")).alias("kind"))


def find_exports(spark: SparkSession, directory: str) -> DataFrame:
    """The chat exports anywhere below a folder, as ``read_binary`` gives files: JSON files named as conversations, and ZIP files with "conversation" in their name."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    wanted = F.when(name.endswith(".zip"), name.contains("conversation")).otherwise(F.col("path").rlike(CONVERSATION_FILE))
    return read_binary(spark, directory, recursive=True).where((F.col("kind") == "chat") & wanted)


def safe_member(name: str) -> str:
    """The member's name with forward slashes; absolute names and those that climb out are errors."""
    plain = name.replace("\\", "/")
    if plain.startswith("/") or ".." in plain.split("/") or plain[1:2] == ":":
        raise ValueError(f"unsafe ZIP member {name!r}")
    return plain


def _zip_members(data: bytes, depth: int) -> Iterator[tuple[str, bytes]]:
    import re

    if depth > MAX_ZIP_DEPTH:
        raise ValueError(f"ZIP files are nested deeper than {MAX_ZIP_DEPTH}")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            plain = safe_member(name)
            if re.search(CONVERSATION_FILE, plain):
                yield plain, z.read(name)
            elif plain.lower().endswith(".zip") and "conversation" in plain.rsplit("/", 1)[-1].lower():
                yield from _zip_members(z.read(name), depth + 1)


def _conversations(data: bytes, name: str) -> Iterator[dict]:
    top = json.loads(data.decode("utf-8-sig"))
    if isinstance(top, dict):
        top = top["conversations"] if isinstance(top.get("conversations"), list) else [top]
    if not isinstance(top, list):
        raise ValueError(f"{name}: no conversations")
    for c in top:
        if not isinstance(c, dict) or not ("mapping" in c or "messages" in c or "current_node" in c):
            raise ValueError(f"{name}: what should be a conversation has no messages")
        yield c


def read_conversations(files: DataFrame, strict: bool = True) -> DataFrame:
    """One row a conversation of JSON and ZIP files (path, content): path, member, ordinal, conversation (its JSON), error. A list, one conversation and {conversations: [...]} are understood.

    A file that can't be read fails the job, or, unless ``strict``, is one row with its error.
    """

    def of(path: str, data: bytes) -> Iterator[tuple]:
        members = _zip_members(data, 1) if path.lower().endswith(".zip") else [(path.rsplit("/", 1)[-1], data)]
        for member, body in members:
            for i, c in enumerate(_conversations(body, member)):
                yield path, member, i, json.dumps(c, ensure_ascii=False), None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for path, data in b.itertuples(index=False):
                try:
                    rows += list(of(path, data))
                except (ValueError, zipfile.BadZipFile) as e:
                    if strict:
                        raise
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "member", "ordinal", "conversation", "error"]).astype({"ordinal": "Int32"})

    return files.select("path", "content").mapInPandas(parse, "path string, member string, ordinal int, conversation string, error string")


def read_documents(files: DataFrame, convert: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """path, content (Markdown), error. Markdown passes through; other kinds need ``convert(path, bytes)``. A failure is a row with its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in b.itertuples(index=False):
                try:
                    if path.lower().endswith((".md", ".markdown")):
                        text = data.decode("utf-8")
                    elif convert is None:
                        raise ValueError("no converter for this kind")
                    else:
                        text = convert(path, data)
                    if not text.strip():
                        raise ValueError("the conversion is empty")
                    rows.append((path, text, None))
                except Exception as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content string, error string")


def read_session_logs(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """session (file), line_no, type, record (JSON) of JSONL files of any size; lines that are blank or no objects are left out.

    Files are read line by line, in splits; a line's number is its place in its
    file. A line that is no JSON fails the job with its number, or, unless
    ``strict``, is left out.
    """
    text = spark.read.text(paths, pathGlobFilter="*.jsonl", recursiveFileLookup=True)
    lines = text.select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_in"), F.col("value").alias("record"))
    placed = positions(lines, "session", ["_at", "_in"]).select("session", (F.col("pos") + 1).alias("line_no"), "record").where(F.trim("record") != "")
    wrong = F.try_parse_json("record").isNull()
    if strict:
        told = F.raise_error(F.concat("session", F.lit(":"), F.col("line_no").cast("string"), F.lit(": no JSON")))
        placed = placed.withColumn("record", F.when(wrong, told.cast("string")).otherwise(F.col("record")))
    return placed.where(F.col("record").rlike(r"^\s*\{") & ~wrong).withColumn("type", F.get_json_object("record", "$.type"))

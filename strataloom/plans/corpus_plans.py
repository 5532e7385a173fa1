"""Token counts, packing, hashes and validation over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.network import ipv4_number, is_private_ipv4, private_ipv4_sql
from strataloom.functions.text import clean_list, strip
from strataloom.functions.tokens import token_count
from strataloom.operators import chunking
from strataloom.plans.tables import current, table

#: The token pattern in RE2's syntax, and all white space that RE2's \s leaves out.
TOKEN_SQL = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]|[A-Za-z0-9_]+(?:[-./:][A-Za-z0-9_]+)*|[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')"


def current_sql(table_name: str, key: str) -> str:
    """Current rows in SQL; rows of a key that share the greatest arrived_at are identical."""
    return f"(SELECT * FROM {table_name} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY arrived_at DESC) = 1)"


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", token_count(F.col("text")).alias("token_count"))


def chunk_token_check(spark: SparkSession, d: str) -> DataFrame:
    """True counts of current chunks beside those they claim."""
    cur = current(spark, d, "knowledge_chunks", ["chunk_id"], ["token_count", token_count(F.col("text")).alias("true_count")])
    return cur.select("chunk_id", F.col("token_count").alias("claimed"), "true_count", F.coalesce(F.col("token_count") == F.col("true_count"), F.lit(False)).alias("agrees"), (F.col("true_count") > 512).alias("oversized"))


def content_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content: how many share a text, and the first of them. One aggregate with partial sums."""
    hashed = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


def line_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack_lines(table(spark, d, "documents"), "doc_id", "text")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?。！？；;]*[.!?。！？；;]|[^.!?。！？；;]+$"), F.lit(0)), lambda x: strip(x) != "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(parts).cast("long").alias("sentences"))


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the current documents by structure."""
    cur = current(spark, d, "norm_documents", ["document_id"], ["content"])
    return chunking.chunk_documents(cur).select("document_id", "chunk_id", "chunk_index", "token_count", F.to_json("section_path").alias("section_path"), F.to_json("block_kinds").alias("block_kinds"), "content_hash")


def acl_clean(spark: SparkSession, d: str) -> DataFrame:
    """Access lists of current documents: stripped, without blanks and repeats, in order."""
    cur = current(spark, d, "norm_documents", ["document_id"], ["security"])
    return cur.select("document_id", *[F.array_join(clean_list(F.col(f"security.{c}")), "|").alias(c) for c in ("allowed_users", "allowed_groups")])


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Current documents by the rule that they break; one that breaks two counts twice."""
    cur = current(spark, d, "norm_documents", ["document_id"], ["created_at", "updated_at", "content_hash", "content", "title"])
    rules = F.array_compact(F.array(
        F.when(F.col("updated_at") < F.col("created_at"), "updated_before_created"), F.when(F.col("content_hash").isNull(), "no_hash"),
        F.when(F.col("content_hash") != F.sha2("content", 256), "other_hash"), F.when(F.coalesce(strip(F.col("content")), F.lit("")) == "", "blank"), F.when(F.col("title") != strip(F.col("title")), "padded_title"),
    ))
    return cur.select(F.explode(rules).alias("rule")).groupBy("rule").agg(F.count("*").alias("documents"))


def private_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of event ids by whether they are private."""
    n = (F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)
    address = F.concat_ws(".", *[(F.floor(n / F.lit(256**k)) % 256).cast("int").cast("string") for k in (3, 2, 1, 0)])
    return table(spark, d, "events").select("event_id", address.alias("address")).select("event_id", "address", ipv4_number(F.col("address")).alias("number"), is_private_ipv4(F.col("address")).alias("private"))


_NUM = "((event_id * 2654435761) % 4294967296)"
QUERIES = {
    "token_count": (token_counts, f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS token_count FROM documents"),
    "chunk_token_check": (chunk_token_check, f"""
        SELECT chunk_id, token_count AS claimed, n AS true_count, coalesce(token_count = n, false) AS agrees, n > 512 AS oversized
        FROM (SELECT chunk_id, token_count, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_SQL}')) AS n FROM {current_sql('knowledge_chunks', 'chunk_id')})"""),
    "content_hash_dedup": (content_hash_dedup, "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "line_pack_chunks": (line_pack, f"""
        WITH RECURSIVE lines AS (
          SELECT doc_id, i, len(regexp_extract_all(line, '{TOKEN_SQL}')) AS n, len(all_lines) AS last
          FROM (SELECT doc_id, string_split(text, chr(10)) AS all_lines, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
        ), walk AS (
          SELECT doc_id, i, n AS used, n, 0 AS g FROM lines WHERE i = 1
          UNION ALL
          SELECT l.doc_id, l.i, CASE WHEN w.used + l.n > 512 THEN l.n ELSE w.used + l.n END, l.n, CASE WHEN w.used + l.n > 512 THEN w.g + 1 ELSE w.g END
          FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1
        ) SELECT doc_id, g AS chunk_index, count(*) AS n_lines, sum(n) AS tokens FROM walk GROUP BY 1, 2"""),
    "sentence_split": (sentence_counts, f"""
        SELECT doc_id, len(list_filter(regexp_extract_all(text, '[^.!?。！？；;]*[.!?。！？；;]|[^.!?。！？；;]+$'), lambda x: {strip_sql('x')} <> '')) AS sentences FROM documents WHERE text IS NOT NULL"""),
    "document_chunks": (document_chunks, None),
    "acl_list_clean": (acl_clean, f"""
        WITH c AS (SELECT document_id, security FROM {current_sql('norm_documents', 'document_id')}),
        one AS (SELECT document_id, 'u' AS k, unnest(security.allowed_users) AS v, generate_subscripts(security.allowed_users, 1) AS i FROM c
                UNION ALL SELECT document_id, 'g', unnest(security.allowed_groups), generate_subscripts(security.allowed_groups, 1) FROM c),
        kept AS (SELECT document_id, k, {strip_sql('v')} AS v, min(i) AS i FROM one WHERE v IS NOT NULL GROUP BY 1, 2, 3),
        listed AS (SELECT document_id, k, string_agg(v, '|' ORDER BY i) AS vs FROM kept WHERE v <> '' GROUP BY 1, 2)
        SELECT c.document_id, CASE WHEN c.security.allowed_users IS NOT NULL THEN coalesce(u.vs, '') END AS allowed_users, CASE WHEN c.security.allowed_groups IS NOT NULL THEN coalesce(g.vs, '') END AS allowed_groups
        FROM c LEFT JOIN listed u ON u.document_id = c.document_id AND u.k = 'u' LEFT JOIN listed g ON g.document_id = c.document_id AND g.k = 'g'"""),
    "integrity_rules": (integrity, f"""
        WITH c AS (SELECT * FROM {current_sql('norm_documents', 'document_id')}), r AS (
          SELECT 'updated_before_created' AS rule FROM c WHERE updated_at < created_at UNION ALL SELECT 'no_hash' FROM c WHERE content_hash IS NULL
          UNION ALL SELECT 'other_hash' FROM c WHERE content_hash <> sha256(content) UNION ALL SELECT 'blank' FROM c WHERE coalesce({strip_sql('content')}, '') = ''
          UNION ALL SELECT 'padded_title' FROM c WHERE title <> {strip_sql('title')}) SELECT rule, count(*) AS documents FROM r GROUP BY 1"""),
    "private_ip_class": (private_addresses, f"""
        SELECT event_id, concat_ws('.', (n // 16777216) % 256, (n // 65536) % 256, (n // 256) % 256, n % 256) AS address, n AS number, {private_ipv4_sql('n')} AS private
        FROM (SELECT event_id, {_NUM} AS n FROM events)"""),
}

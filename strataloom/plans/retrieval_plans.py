"""Vector and text search, fusion and presentation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators import filters, presentation, retrieval, search
from strataloom.plans.corpus_plans import current_sql, strip_sql
from strataloom.plans.tables import current, table
from strataloom.scratch import materialize, scratch_root
from strataloom.sources import index

QUESTION = "why does the encrypted gateway reject the nightly snapshot"
PROBE = [round(((i * 37) % 64 - 31.5) / 40.0, 4) for i in range(64)]
_PROBE_SQL = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


def _cos_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


def dense(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_topk(table(spark, d, "embeddings"), PROBE, 20, "vec_id", "embedding").withColumn("score", F.round("score", 6))


def _records(spark: SparkSession, d: str) -> DataFrame:
    cols = ["vector", "tenant_id", "domain", "project", "classification", "source_type", "provider"]
    return current(spark, d, "chunk_records", ["chunk_id"], cols)


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The best of one project, among vectors that can be compared."""
    kept = filters.narrowed(_records(spark, d), {"project": "atlas-core"})
    usable = kept.where((retrieval.usable_vector(F.col("vector"), 64) == "ok") & F.exists("vector", lambda x: x != 0))
    return retrieval.dense_topk(usable, PROBE, 20).withColumn("score", F.round("score", 6))


def dense_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, against all vectors."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk_many(e, queries, 5, "vec_id", "embedding")


def vector_states(spark: SparkSession, d: str) -> DataFrame:
    rec = current(spark, d, "chunk_records", ["chunk_id"], ["vector"])
    return rec.groupBy(retrieval.usable_vector(F.col("vector"), 64).alias("state")).agg(F.count("*").alias("records"))


def bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "documents"), QUESTION, 20, "doc_id", "text")


def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(table(spark, d, "documents"), QUESTION, 20, "doc_id", "text", keep=F.coalesce(F.lower(F.trim("source")) == "wiki", F.lit(False)))


def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking from a posting table, which is written first."""
    docs = table(spark, d, "documents")
    path = f"{scratch_root(spark)}/postings-{uuid.uuid4().hex}"
    retrieval.write_postings(docs, "doc_id", "text", path)
    lengths = materialize(retrieval.corpus_lengths(docs, "text"), "lengths")
    return retrieval.bm25_postings(spark.read.parquet(path), lengths, QUESTION, 20, "doc_id")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """One request to the chunk index: a question, a vector, one project."""
    cols = ["document_id", "chunk_index", "text", "source", "title", "section_path", "token_count", "domain", "project", "security"]
    chunks = index.index_rows(current(spark, d, "knowledge_chunks", ["chunk_id"], cols))
    rows = chunks.join(current(spark, d, "chunk_records", ["chunk_id"], ["vector"]), "chunk_id", "left")
    hits = search.search(rows, search.Request(QUESTION, 15, {"project": " atlas-core "}), PROBE)
    return hits.select("position", "score", "branch", "chunk_id", "document_id")


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    near = retrieval.dense_topk(table(spark, d, "embeddings"), PROBE, 20, "vec_id", "embedding").withColumn("score", F.round("score", 6)).withColumnRenamed("vec_id", "doc_id")
    return near, bm25(spark, d)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(*_hybrid(spark, d), 30, "doc_id")


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fuse(*_hybrid(spark, d), 30, "doc_id", "rrf")


def corpus_terms(spark: SparkSession, d: str) -> DataFrame:
    """Document and total frequency of every term: the dictionary of the inverted index."""
    p = retrieval.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def budget(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the longest documents, as many as fit the budget."""
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "text").where("source <> ''")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("rank <= 8")
    shown = presentation.within_budget(ranked, "rank", F.coalesce("text", F.lit("")), presentation.Budget(max_results=5, max_chars=10_000), ["source"])
    return shown.select("source", "doc_id", "rank", F.col("chars").cast("long").alias("chars"), "total_chars", "truncated")


def attribution(spark: SparkSession, d: str) -> DataFrame:
    rec = current(spark, d, "chunk_records", ["chunk_id"], ["document_id", "source_type", "provider", "source_id", "metadata_json"])
    row = {c: F.col(c) for c in ("document_id", "source_type", "provider", "source_id")}
    s = presentation.attribution(F.col("metadata_json"), row)
    return rec.select("chunk_id", s.alias("s")).select("chunk_id", "s.title", "s.document_id", "s.source_type", "s.provider", "s.source_id", F.col("s.chunk_index").cast("long").alias("chunk_index"), F.coalesce(F.size("s.section_path"), F.lit(0)).cast("long").alias("path_length"))


def project_index(spark: SparkSession, d: str) -> DataFrame:
    """Records by tenant, project and classification."""
    return _records(spark, d).groupBy("tenant_id", "project", "classification").agg(F.count("*").alias("records"))


_TERMS = sorted(set(QUESTION.split()))
_WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')"


def _bm25_sql(keep: str, rows: str = "documents", key: str = "doc_id") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"count(*) FILTER (t{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))" for i in range(len(_TERMS)))
    some = " OR ".join(f"t{i} > 0" for i in range(len(_TERMS)))
    return f"""WITH b AS (SELECT {key}, coalesce({keep}, false) AS keep, len(w) AS dl, {tf} FROM (SELECT *, {_WORDS_SQL} AS w FROM {rows})),
      s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM b),
      r AS (SELECT {key}, round({score}, 6) AS score FROM b, s WHERE keep AND ({some}))
      SELECT {key}, score, row_number() OVER (ORDER BY score DESC, {key}) AS rank FROM r QUALIFY rank <= 20"""


_DENSE_SQL = f"SELECT vec_id, round({_cos_sql('v', _PROBE_SQL)}, 6) AS score, row_number() OVER (ORDER BY {_cos_sql('v', _PROBE_SQL)} DESC, vec_id) AS rank FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) QUALIFY rank <= 20"
_META = lambda f: f"nullif({strip_sql(chr(39).join(['json_extract_string(metadata_json, ', '$.' + f, ')']))}, '')"
_OWN = lambda f: f"coalesce(nullif({strip_sql(f)}, ''), {_META(f)})"
QUERIES = {
    "dense_topk": (dense, _DENSE_SQL),
    "dense_topk_filtered": (dense_filtered, f"""
        WITH u AS (SELECT chunk_id, vector::DOUBLE[] AS v FROM {current_sql('chunk_records', 'chunk_id')} WHERE project = 'atlas-core' AND len(vector) = 64 AND list_bool_and([isfinite(x) for x in vector]) AND list_bool_or([x <> 0 for x in vector]))
        SELECT chunk_id, round({_cos_sql('v', _PROBE_SQL)}, 6) AS score, row_number() OVER (ORDER BY {_cos_sql('v', _PROBE_SQL)} DESC, chunk_id) AS rank FROM u QUALIFY rank <= 20"""),
    "dense_topk_batch": (dense_batch, f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round({_cos_sql('q.v', 'e.v')}, 6) AS score FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
        SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""),
    "vector_states": (vector_states, f"""
        SELECT CASE WHEN vector IS NULL THEN 'null' WHEN len(vector) <> 64 THEN 'dimension' WHEN NOT list_bool_and([coalesce(isfinite(x), false) for x in vector]) THEN 'not_finite' ELSE 'ok' END AS state, count(*) AS records
        FROM {current_sql('chunk_records', 'chunk_id')} GROUP BY 1"""),
    "bm25_topk": (bm25, _bm25_sql("true")),
    "bm25_filtered": (bm25_filtered, _bm25_sql("lower(trim(source)) = 'wiki'")),
    "bm25_indexed": (bm25_indexed, _bm25_sql("true")),
    "hybrid_search": (hybrid_search, f"""
        WITH c AS (SELECT chunk_id, document_id, text, project FROM {current_sql('knowledge_chunks', 'chunk_id')}),
        u AS (SELECT c.chunk_id, vector::DOUBLE[] AS v FROM c JOIN {current_sql('chunk_records', 'chunk_id')} r ON r.chunk_id = c.chunk_id WHERE c.project = 'atlas-core' AND len(vector) = 64 AND list_bool_and([isfinite(x) for x in vector]) AND list_bool_or([x <> 0 for x in vector])),
        n AS (SELECT chunk_id, round({_cos_sql('v', _PROBE_SQL)}, 6) AS score, row_number() OVER (ORDER BY {_cos_sql('v', _PROBE_SQL)} DESC, chunk_id) AS rank FROM u QUALIFY rank <= 20),
        t AS ({_bm25_sql("project = 'atlas-core'", 'c', 'chunk_id')}),
        a AS (SELECT chunk_id, score, 0 AS branch, rank FROM n UNION ALL SELECT chunk_id, score, 1, rank FROM t WHERE chunk_id NOT IN (SELECT chunk_id FROM n)),
        p AS (SELECT chunk_id, score, branch, row_number() OVER (ORDER BY branch, rank) AS position FROM a QUALIFY position <= 15)
        SELECT position, score, branch, p.chunk_id, document_id FROM p JOIN c ON c.chunk_id = p.chunk_id"""),
    "hybrid_fuse": (hybrid, f"""
        WITH d AS ({_DENSE_SQL}), b AS ({_bm25_sql('true')}), a AS (SELECT vec_id AS doc_id, score, 0 AS branch, rank FROM d UNION ALL SELECT doc_id, score, 1, rank FROM b WHERE doc_id NOT IN (SELECT vec_id FROM d))
        SELECT doc_id, score, branch, row_number() OVER (ORDER BY branch, rank) AS position FROM a QUALIFY position <= 30"""),
    "hybrid_rrf": (hybrid_rrf, f"""
        WITH d AS ({_DENSE_SQL}), b AS ({_bm25_sql('true')}), a AS (SELECT vec_id AS doc_id, 0 AS branch, rank FROM d UNION ALL SELECT doc_id, 1, rank FROM b), g AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, min(branch) AS branch FROM a GROUP BY 1)
        SELECT doc_id, score, branch, row_number() OVER (ORDER BY score DESC, doc_id) AS position FROM g QUALIFY position <= 30"""),
    "term_dictionary": (corpus_terms, f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS term FROM documents) GROUP BY 1"),
    "budget_format": (budget, """
        WITH k AS (SELECT lower(trim(source)) AS source, doc_id, coalesce(n_chars, 0) AS n_chars, coalesce(text, '') AS text FROM documents WHERE trim(source) <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM k QUALIFY rank <= 8),
        t AS (SELECT source, doc_id, rank, length(text) AS chars, sum(length(text)) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total_chars FROM r)
        SELECT source, doc_id, rank, chars, total_chars, rank = 1 AND chars > 10000 AS truncated FROM t WHERE rank <= 5 AND (total_chars <= 10000 OR rank = 1)"""),
    "source_attribution": (attribution, f"""
        SELECT chunk_id, {_META('title')} AS title, {_OWN('document_id')} AS document_id, {_OWN('source_type')} AS source_type, {_OWN('provider')} AS provider, {_OWN('source_id')} AS source_id,
          TRY_CAST(json_extract_string(metadata_json, '$.chunk_index') AS BIGINT) AS chunk_index, coalesce(json_array_length(metadata_json, '$.section_path'), 0) AS path_length FROM {current_sql('chunk_records', 'chunk_id')}"""),
    "records_by_scope": (project_index, f"SELECT tenant_id, project, classification, count(*) AS records FROM {current_sql('chunk_records', 'chunk_id')} GROUP BY 1, 2, 3"),
}

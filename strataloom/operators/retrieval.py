"""Exact vector search, BM25, and their fusion."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.scratch import materialize

TERM_RE = r"[\p{L}\p{N}_]+"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str = "COSINE") -> Column:
    """COSINE and IP rank downwards, L2 (the distance) upwards."""
    if metric == "COSINE":
        return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))
    if metric == "IP":
        return _dot(a, b)
    if metric == "L2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    raise ValueError(f"unknown metric {metric!r}")


def dense_topk(index: DataFrame, vector: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "vector", metric: str = "COSINE") -> DataFrame:
    """The k best rows for one vector, as (id, score, rank). Rows of another dimension don't take part.

    Only id and vector are read; the plan is a scan and a TakeOrderedAndProject.
    Equal scores go by id.
    """
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = index.where(F.size(vector_col) == len(vector)).select(id_col, similarity(F.col(vector_col), q, metric).alias("score")).where("score is not null")
    score = F.asc("score") if metric == "L2" else F.desc("score")
    top = scored.orderBy(score, id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(score, id_col)))


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.2
    b: float = 0.75


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, id, tf, dl: the inverted index with each document's length beside its terms."""
    terms = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM_RE), F.lit(0))
    each = docs.select(id_col, terms.alias("terms")).select(id_col, F.size("terms").alias("dl"), F.explode_outer("terms").alias("term")).where("term is not null")
    return each.groupBy("term", id_col, "dl").agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"\w+", query.lower())))


def _score(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, config: Bm25Config) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * dl / avgdl))


def _ranked(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def bm25_topk(docs: DataFrame, query: str, k: int, id_col: str, text_col: str, keep: Column | None = None, config: Bm25Config = Bm25Config()) -> DataFrame:
    """The k best rows for a query, as (id, score, rank), by a scan of the texts. Statistics are of all ``docs``; ``keep`` narrows what is ranked.

    One pass counts each text's words and the query's terms in it and writes these few numbers; statistics and
    hits come from them, so no text is taken apart twice. For many queries see ``bm25_postings``.
    """
    terms = query_terms(query)
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM_RE), F.lit(0))
    counted = docs.withColumn("_w", words).withColumn("_q", F.filter("_w", lambda w: w.isin(terms)))
    base = counted.select(F.col(id_col), (keep if keep is not None else F.lit(True)).alias("_keep"), F.size("_w").alias("dl"), *[_times("_q", t).alias(f"_t{i}") for i, t in enumerate(terms)])
    base = materialize(base, "bm25")
    stats = base.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    hits = base.where(F.col("_keep") & reduce(lambda a, b: a | b, [F.col(f"_t{i}") > 0 for i in range(len(terms))], F.lit(False)))
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    parts = [_score(F.col(f"_t{i}").cast("double"), F.col(f"_df{i}"), F.col("_n"), F.col("dl"), F.col("_avgdl"), config) for i in range(len(terms))]
    return _ranked(joined.select(id_col, F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), 6).alias("score")), k, id_col)


def corpus_lengths(docs: DataFrame, text_col: str) -> DataFrame:
    """One row: n, avgdl."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM_RE))).alias("avgdl"))


def write_postings(docs: DataFrame, id_col: str, text_col: str, path: str, tasks: int | None = None) -> None:
    """The inverted index as a table, in files by ranges of terms: a query reads the files and row groups of its terms alone.

    A term that very many texts have goes on over several files, as ids are part of the order.
    """
    ordered = postings(docs, id_col, text_col)
    ranged = ordered.repartitionByRange(tasks, "term", id_col) if tasks else ordered.repartitionByRange("term", id_col)
    ranged.sortWithinPartitions("term", id_col).write.mode("overwrite").parquet(path)


def bm25_postings(index: DataFrame, lengths: DataFrame, query: str, k: int, id_col: str, config: Bm25Config = Bm25Config()) -> DataFrame:
    """As ``bm25_topk``, from the postings (term, id, tf, dl) and ``corpus_lengths``: no text is read."""
    mine = index.where(F.col("term").isin(query_terms(query)))
    df = mine.groupBy("term").agg(F.count("*").alias("df"))
    joined = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(lengths))  # a row a term, and one row
    each = joined.select(id_col, _score(F.col("tf").cast("double"), F.col("df"), F.col("n"), F.col("dl"), F.col("avgdl"), config).alias("s"))
    return _ranked(each.groupBy(id_col).agg(F.round(F.sum("s"), 6).alias("score")), k, id_col)


def dense_topk_many(index: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vector_col: str = "vector", query_id: str = "query_id", block_rows: int = 4096) -> DataFrame:
    """The k of ``index`` nearest by cosine to every row of ``queries`` (query_id, vector), itself left out: query_id, id, score (rounded), rank.

    Exact: blocks of queries meet blocks of rows, each pair of blocks one product of
    matrices in a task that keeps the k best of each query. No block is larger than
    about ``block_rows``, nothing is broadcast. All vectors have one length; null
    ones, and ones that are all zero or not finite, are no one's neighbours.
    """
    usable = lambda df, c: df.where(F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(c, lambda x: x != 0))
    rows, asks = usable(index, vector_col), usable(queries, "vector")
    n, m = (max(1, math.ceil(df.count() / block_rows)) for df in (rows, asks))
    of = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    left = rows.select(of(id_col, n).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("b"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    right = asks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"), of(query_id, m).alias("b"), F.col(query_id).alias("q"), F.col("vector").cast("array<float>").alias("v"))
    kinds = index.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()

    def unit(t: pa.Table) -> np.ndarray:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    def nearest(own: pa.Table, asking: pa.Table) -> pa.Table:
        qs, ids, scores = [], [], []
        if own.num_rows and asking.num_rows:
            id_, q_ = own.column("id").to_numpy(), asking.column("q").to_numpy()
            best = np.round(unit(asking) @ unit(own).T, 6)
            best[q_[:, None] == id_[None, :]] = -np.inf
            least = np.partition(best, max(0, best.shape[1] - k), axis=1)[:, max(0, best.shape[1] - k)]
            i, j = np.nonzero((best >= least[:, None]) & (best > -np.inf))  # all of those that tie with the last
            qs, ids, scores = q_[i], id_[j], best[i, j]
        return pa.table({"query_id": pa.array(qs, asking.schema.field("q").type), "id": pa.array(ids, own.schema.field("id").type), "score": pa.array(scores, pa.float64())})

    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(nearest, f"query_id {kinds[1]}, id {kinds[0]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "score", "rank")


def _times(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == F.lit(term)))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, id_col: str, how: str = "dense_first") -> DataFrame:
    """``dense_first``: the dense rows in order, then the unseen sparse ones, scores as they are. ``rrf``: by the sum of 1 / (60 + rank)."""
    d = dense.select(id_col, "score", F.lit(0).alias("branch"), "rank")
    s = sparse.select(id_col, "score", F.lit(1).alias("branch"), "rank")
    if how == "rrf":
        both = d.unionByName(s).groupBy(id_col).agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.min("branch").alias("branch"))
        order = [F.desc("score"), F.col(id_col)]
    elif how == "dense_first":
        both, order = d.unionByName(s.join(d.select(id_col), id_col, "left_anti")), [F.col("branch"), F.col("rank")]
    else:
        raise ValueError(f"unknown fusion {how!r}")
    top = both.orderBy(*order).limit(k)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).select(id_col, "score", "branch", "position")


def usable_vector(v: Column, dim: int) -> Column:
    """Why a vector can't be indexed: null, dimension, not_finite; or ok."""
    return (
        F.when(v.isNull(), "null").when(F.size(v) != dim, "dimension")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite").otherwise("ok")
    )

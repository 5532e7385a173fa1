"""Hybrid search over the chunk index: one entry for vector, text and filters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators import filters, retrieval


@dataclass(frozen=True)
class Request:
    """``query`` isn't blank, ``top_k`` is 1 to 100, ``wanted`` are filters as ``filters.conditions`` checks them."""

    query: str
    top_k: int = 10
    wanted: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("the query is blank")
        if type(self.top_k) is not int or not 1 <= self.top_k <= 100:
            raise ValueError("top_k is 1 to 100")
        filters.conditions(self.wanted)


def search(index: DataFrame, request: Request, vector: list[float] | None = None, tenant: str | None = None, how: str = "dense_first", branch_limit: int = 20) -> DataFrame:
    """position, score, branch (0 dense, 1 text) and the index's columns of the hits of a request.

    The tenant and the filters narrow the index before either branch ranks it; each
    branch gives ``branch_limit`` hits at least. Without a vector the text branch is
    alone. Text statistics are of the whole index. Rows whose vector is unusable, or
    of another length, are found by text only. Ids are unique.
    """
    fits = filters.predicate(request.wanted, tenant, index.schema if any(f.metadata for f in index.schema.fields) else filters.INDEX_SCHEMA)
    most = max(branch_limit, request.top_k)
    text = retrieval.bm25_topk(index, request.query.strip(), most, "chunk_id", "text", keep=None if fits is None else F.coalesce(fits, F.lit(False)))
    inside = index if fits is None else index.where(fits)
    if vector is None:
        ranked = text.select("chunk_id", "score", F.lit(1).alias("branch"), F.col("rank").alias("position")).where(F.col("position") <= request.top_k)
    else:
        usable = inside.where(retrieval.usable_vector(F.col("vector"), len(vector)) == "ok")
        near = retrieval.dense_topk(usable, vector, most).withColumn("score", F.round("score", 6))
        ranked = retrieval.fuse(near, text, request.top_k, "chunk_id", how)
    return inside.join(F.broadcast(ranked), "chunk_id").select("position", "score", "branch", *index.columns)  # at most top_k hits

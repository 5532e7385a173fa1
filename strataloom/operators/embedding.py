"""Vectors of texts by a model that is passed in. Texts go to the model in Arrow batches inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str], int], Sequence[Sequence[float]]]  # texts, greatest length in tokens -> vectors


@dataclass(frozen=True)
class EmbeddingConfig:
    dimension: int = 1024
    batch_size: int = 32
    query_length: int = 512
    passage_length: int = 512

    def __post_init__(self) -> None:
        if min(self.dimension, self.batch_size, self.query_length, self.passage_length) <= 0:
            raise ValueError("sizes are positive")


def checked_vectors(vectors: Sequence[Sequence[float]], n: int, dimension: int) -> list[list[float]]:
    """``vectors`` as lists; raises if their number, a length or a value (no bool, NaN or infinity) is wrong."""
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"a vector of {len(v)} values instead of {dimension}")
        if any(type(x).__name__.startswith("bool") or not math.isfinite(x) for x in v):
            raise ValueError("a vector has a value that is no finite number")
    return [[float(x) for x in v] for v in vectors]


def embed(df: DataFrame, text: Column, factory: Callable[[], Model], config: EmbeddingConfig = EmbeddingConfig(), query: bool = False, output: str = "vector") -> DataFrame:
    """``df`` with ``output``, an array<float> of the config's dimension; a null or blank text fails the job, as it has no vector.

    ``factory`` makes the model once a Python worker and task; batches of another
    size than the model's are cut, so that memory doesn't depend on Arrow's.
    """
    length = config.query_length if query else config.passage_length

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for batch in batches:
            texts = batch.tolist()
            if any(not isinstance(t, str) or not t.strip() for t in texts):
                raise ValueError("a text is null or blank")
            out: list[list[float]] = []
            for at in range(0, len(texts), config.batch_size):
                model = model or factory()
                part = texts[at : at + config.batch_size]
                out += checked_vectors(model(part, length), len(part), config.dimension)
            yield pd.Series(out, dtype=object)

    return df.withColumn(output, vectors(text))

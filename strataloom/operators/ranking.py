"""Positions within groups of any size, and hashes of their rows in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.scratch import materialize


def positions(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with each row's 0-based position in its group, without bringing a group into one task.

    A range partitioning by group and order cuts a large group into runs; a row's
    position is its place in its run plus the sizes of the group's runs before.
    The window over runs has one row a group and partition.
    """
    ranged = materialize(df.repartitionByRange(group, *order).withColumn("_run", F.spark_partition_id()), "ranged")
    within = Window.partitionBy(group, "_run").orderBy(*order)
    sizes = ranged.groupBy(group, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_g"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = ranged.withColumn("_place", F.row_number().over(within) - 1)
    joined = placed.join(starts, (F.col(group) == F.col("_g")) & (F.col("_run") == F.col("_r")))
    return joined.withColumn(name, (F.col("_place") + F.col("_start")).cast("long")).drop("_run", "_place", "_g", "_r", "_start")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (group, at, digest) that come sorted. Only the hash so far is held."""
    state = None  # group, hash, rows, first, last
    names, kinds = ["g", "hash", "n", "first_at", "last_at"], [pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()]

    def done(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([(r[0], r[1].hexdigest(), *r[2:])[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for b in batches:
        out = []
        for group, rows in groupby(zip(*[c.to_pylist() for c in b.columns]), key=lambda r: r[0]):
            rows = list(rows)
            text = "\n".join(r[2].hex() for r in rows)
            if state is not None and state[0] == group:
                state[1].update(("\n" + text).encode())
                state = (group, state[1], state[2] + len(rows), state[3], rows[-1][1])
            else:
                if state is not None:
                    out.append(state)
                state = (group, hashlib.sha256(text.encode()), len(rows), rows[0][1], rows[-1][1])
        yield done(out)
    if state is not None:
        yield done([state])


def ordered_hash(df: DataFrame, group: str, at: str, tie: str, digest: str) -> DataFrame:
    """g, hash, n, first_at, last_at: SHA-256 of each group's digests (binary, in hexadecimal, joined by line ends) by ``at`` (double) and ``tie``.

    A hash is a chain, so a group's digests pass through one task; they come
    sorted, by a sort that spills, and none is held.
    """
    ordered = df.select(group, at, tie, digest).repartition(group).sortWithinPartitions(group, at, tie, digest)
    return ordered.select(group, at, digest).mapInArrow(_hashed, "g string, hash string, n long, first_at double, last_at double")

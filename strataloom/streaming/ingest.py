"""Incremental ingest: new files of deliveries are folded into the current rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strataloom.operators.current import current_rows


def stream_current(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, buckets: int = 64, keep: int = 2
) -> StreamingQuery:
    """Read new Parquet files of ``source`` as they come; each batch is merged with ``target``, of which only the parts that it touches are read and written.

    ``target`` holds versions ``v=<batch>`` of parts ``bucket=<hash of the keys>``;
    a version has the parts that its batch touched, and :func:`latest` reads the
    newest of each. A version counts once it is whole (its job's mark is written),
    and a batch that is run again after a failure starts from the versions before
    it and writes its own again, so the result is the same. Of parts that newer
    versions replace those of the last ``keep`` states stay, for readers at work.
    ``buckets`` goes with the target's size and can't be changed later; a part may
    be several files, and a key that is delivered very often is one row of it.
    """
    columns = [f.name for f in transform(spark.createDataFrame([], schema)).schema.fields]

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = current_rows(transform(batch), keys, [c for c in columns if c not in keys]).select(*columns).withColumn("bucket", bucket).persist()
        try:
            touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # no more than ``buckets``
            old = latest(session, target, number - 1, touched)
            both = new.drop("bucket") if old is None else old.select(*columns).unionByName(new.drop("bucket"))
            merged = current_rows(both, keys, [c for c in columns if c not in keys]).select(*columns).withColumn("bucket", bucket)
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        finally:
            new.unpersist()
        _prune(session, target, number, keep)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """The parts that each whole version has."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(of: str, prefix: str) -> list[int]:
        names = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(of))]
        return [int(n[len(prefix) :]) for n in names if n.startswith(prefix)]

    if not fs.exists(path):
        return {}
    whole = [v for v in numbers(target, "v=") if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/_SUCCESS"))]
    return {v: numbers(f"{target}/v={v}", "bucket=") for v in sorted(whole)}


def _state(parts: dict[int, list[int]], most: int | None = None) -> dict[int, int]:
    """The newest version of each part, among those up to ``most``."""
    return {b: v for v in sorted(parts) if most is None or v <= most for b in parts[v]}


def _prune(spark: SparkSession, target: str, number: int, keep: int) -> None:
    """Delete parts that none of the last ``keep`` states has, nor the one that the batch of this number starts from."""
    parts = _parts(spark, target)
    used = {(v, b) for back in range(max(keep, 2)) for b, v in _state(parts, number - back).items()}
    for v, b in {(v, b) for v in parts for b in parts[v] if v <= number} - used:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/bucket={b}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def latest(spark: SparkSession, target: str, most: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The rows of the newest state, or of that of version ``most``; of some parts only if ``buckets`` names them. None if there is none."""
    paths = [f"{target}/v={v}/bucket={b}" for b, v in sorted(_state(_parts(spark, target), most).items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None

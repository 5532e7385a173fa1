"""The raw evidence store: content-addressed keys and an append that writes each object once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.scratch import materialize


def valid_key(key: Column) -> Column:
    """Relative, without NUL, backslash, and empty, '.' or '..' parts."""
    parts = F.split(key, "/")
    return (F.length(key) > 0) & ~key.contains("\\") & ~key.contains("\x00") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))


def safe_segment(c: Column, fallback: str) -> Column:
    cleaned = F.left(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "-"), F.lit("-._")), F.lit(96))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(fallback))


def safe_filename(name: Column) -> Column:
    """A clean stem with the suffix kept where it is plain."""
    suffix = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,16})$", 1)
    return F.concat(safe_segment(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)), "file"), F.lower(suffix))


def raw_key(tenant: Column, kind: Column, sha256: Column, filename: Column) -> Column:
    return F.concat_ws("/", F.lit("tenants"), safe_segment(tenant, "default"), F.lit("sources"), safe_segment(kind, "source"), F.substring(sha256, 1, 2), sha256, safe_filename(filename))


def put_once(spark: SparkSession, objects: DataFrame, table_path: str) -> DataFrame:
    """Append the objects (raw_key, …) that the table lacks; returns raw_key and raw_object_reused of all. Parquet's task commits make the append whole."""
    exists = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    there = exists.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(exists)
    distinct = objects.dropDuplicates(["raw_key"])
    if not there:
        distinct.write.parquet(table_path)
        return distinct.select("raw_key", F.lit(False).alias("raw_object_reused"))
    known = spark.read.parquet(table_path).select("raw_key").withColumn("raw_object_reused", F.lit(True))
    told = materialize(distinct.select("raw_key").join(known, "raw_key", "left").na.fill(False, ["raw_object_reused"]), "put")
    distinct.join(told.where(~F.col("raw_object_reused")).select("raw_key"), "raw_key", "left_semi").write.mode("append").parquet(table_path)
    return told


def get(spark: SparkSession, table_path: str, keys: list[str]) -> DataFrame:
    """The stored objects of some keys. An invalid or unknown key is an error."""
    if wrong := [k for k in keys if not k or "\\" in k or "\0" in k or any(p in ("", ".", "..") for p in k.split("/"))]:
        raise ValueError(f"invalid keys: {wrong}")
    found = spark.read.parquet(table_path).where(F.col("raw_key").isin(keys))
    if missing := set(keys) - {r.raw_key for r in found.select("raw_key").collect()}:
        raise ValueError(f"unknown keys: {sorted(missing)}")
    return found

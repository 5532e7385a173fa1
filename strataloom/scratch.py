"""Written tables that cut lineage.

A query that reads an intermediate result more than once writes it as Parquet
below ``spark.checkpoint.dir`` (a folder all executors share), so a lost
executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. Where the setting is absent, a local master gets a folder of its own; on a cluster executors can't read each other's disks, so it is an error."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-strataloom-")
        root = _OWN[context.applicationId]
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back. The folder is deleted when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/strataloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)

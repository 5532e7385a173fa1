"""Current rows of tables that hold deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def file_row() -> Column:
    """Which row of a file a row is: ``row_id`` of tables that are read from files."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def _age(arrived: Column) -> Column:
    return F.coalesce(arrived.cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def row_version(arrived: Column, row_id: Column) -> Column:
    """One number that orders rows by age and then by ``row_id`` (a long that no two rows share)."""
    return F.unix_micros(_age(arrived)).cast("decimal(18,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") + row_id.cast("decimal(19,0)")


def newest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The greatest ``version`` of each key: a hash aggregate over numbers; rows with a null in a key are left out."""
    named = df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
    return named.groupBy(*keys).agg(F.max(version).alias(version)).select(version)


def current_rows(df: DataFrame, keys: list[str], payload: list[Column | str], arrived: str = "arrived_at", row_id: Column | None = None, where: Column | None = None) -> DataFrame:
    """One row per key: that of the greatest ``arrived``; a null one is older than any other. Rows with a null in a key are dropped: they name nothing.

    With a ``row_id`` (``file_row()`` for files) keys and ages alone are aggregated,
    and the payload meets the chosen rows by their version: it is shuffled once,
    never sorted, and a key that is delivered very often is spread evenly.
    ``where``: only current rows that it holds for are wanted; with a ``row_id`` others aren't shuffled.

    Without one, rows are aggregated with their payload, in one shuffle: partial
    sums make one row a key and map task, for which Spark sorts a task's rows by
    key. Rows of equal age are identical by contract; if they aren't, the one with
    the greatest hash wins here, and any one, but always the same, with a ``row_id``.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in payload]
    if row_id is not None:
        versions = df.select(*keys, row_version(F.col(arrived), row_id).alias("_version"))
        rows = (df if where is None else df.where(where)).select(*keys, *cols, row_version(F.col(arrived), row_id).alias("_version"))
        return rows.join(newest_versions(versions, keys, "_version").hint("shuffle_hash"), "_version", "left_semi").drop("_version")
    if where is not None:
        cols = [*cols, where.alias("_wanted")]
    state = df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0).select(*keys, F.struct(*cols).alias("_row"), F.col(arrived).alias("_at"))
    out = state.groupBy(*keys).agg(F.max_by("_row", F.struct(_age(F.col("_at")), F.xxhash64("_row"))).alias("_row")).select(*keys, "_row.*")
    return out if where is None else out.where("_wanted").drop("_wanted")

"""Text helpers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (``trim`` takes spaces alone)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def first_nonempty(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cs])


def clean_list(c: Column, distinct: bool = True) -> Column:
    """Items stripped, blanks and nulls dropped; ``distinct`` keeps the first of equals."""
    kept = F.filter(F.transform(c, strip), lambda v: v != "")
    return F.array_distinct(kept) if distinct else kept


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))


def epoch_to_timestamp(v: Column) -> Column:
    """Epoch seconds, or milliseconds from 1e11 on, as a timestamp; null for NaN and infinities."""
    fine = ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(fine, F.timestamp_micros(F.round(F.when(F.abs(v) >= 1e11, v * 1000.0).otherwise(v * 1e6)).cast("long")))


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def normalize_extension(ext: Column) -> Column:
    """``md`` and ``.MD`` become ``.md``; blank gives null."""
    return F.concat(F.lit("."), F.nullif(F.ltrim(F.lower(strip(ext)), F.lit(".")), F.lit("")))

"""Narrowing a search: equality on columns of the index, and the caller's tenant, as one predicate.

Which columns can be asked for, and how long a value may be, is what the index's
schema says (``filter_length`` in a field's metadata).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.sources.index import INDEX_SCHEMA


def conditions(wanted: Mapping[str, str | None], schema: T.StructType = INDEX_SCHEMA) -> list[tuple[str, str]]:
    """(column, value) in the schema's order, values without surrounding white space; None asks for nothing. An unknown column, and a blank or too long value, is an error."""
    lengths = {f.name: f.metadata["filter_length"] for f in schema.fields if "filter_length" in f.metadata}
    if unknown := set(wanted) - set(lengths):
        raise ValueError(f"no filters: {', '.join(sorted(unknown))}")
    asked = [(name, wanted[name].strip(), most) for name, most in lengths.items() if wanted.get(name) is not None]
    if wrong := [name for name, value, most in asked if not 0 < len(value) <= most]:
        raise ValueError(f"values are blank or too long: {', '.join(wrong)}")
    return [(name, value) for name, value, _ in asked]


def predicate(wanted: Mapping[str, str | None], tenant: str | None = None, schema: T.StructType = INDEX_SCHEMA) -> Column | None:
    """The tenant first, then the columns; None if nothing is asked for. ``tenant`` is set by the service, never by a request; a blank one is an error."""
    if tenant is not None and not tenant.strip():
        raise ValueError("the tenant is blank")
    pairs = [*([("tenant_id", tenant.strip())] if tenant is not None else []), *conditions(wanted, schema)]
    return reduce(Column.__and__, [F.col(name) == F.lit(value) for name, value in pairs]) if pairs else None


def narrowed(df: DataFrame, wanted: Mapping[str, str | None], tenant: str | None = None) -> DataFrame:
    """Rows that fit. Parquet scans get each equality pushed down."""
    fits = predicate(wanted, tenant)
    return df if fits is None else df.where(fits)

"""Schema introspection: which columns an operator may work on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Kinds:
    """Columns of a table by kind; nested and binary columns land in ``skipped`` and are reported, not profiled."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    temporal: tuple[str, ...]
    skipped: tuple[str, ...]


def columns_by_kind(df: DataFrame, exclude=()) -> Kinds:
    numeric, categorical, temporal, skipped = [], [], [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            categorical.append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            temporal.append(f.name)
        else:
            skipped.append(f.name)
    return Kinds(tuple(numeric), tuple(categorical), tuple(temporal), tuple(skipped))


def quality_type_label(dtype: T.DataType) -> str:
    """Coarse type name used in quality profiles."""
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, T.NumericType):
        return "DECIMAL"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "STRING"

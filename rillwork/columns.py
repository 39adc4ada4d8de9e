"""Column references: a name or a zero-based position."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError

ColumnRef = int | str

#: The declarable field types and their Spark names.
FIELD_TYPES = {"STRING": "string", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean", "BYTE": "tinyint", "FLOAT": "float", "LONG": "bigint", "TIMESTAMP": "timestamp"}


def name_of(df: DataFrame, ref: ColumnRef) -> str:
    if isinstance(ref, bool) or not isinstance(ref, int | str):
        raise ValidationError(f"not a column reference: {ref!r}")
    if isinstance(ref, int):
        if not 0 <= ref < len(df.columns):
            raise ValidationError(f"no column at position {ref}")
        return df.columns[ref]
    if ref.strip() not in df.columns:
        raise ValidationError(f"no column {ref!r} among {df.columns}")
    return ref.strip()


def names_of(df: DataFrame, refs: Iterable[ColumnRef]) -> list[str]:
    return [name_of(df, r) for r in refs]


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def spark_type(field_type: str) -> str:
    kind = field_type.strip().upper()
    if kind not in FIELD_TYPES:
        raise ValidationError(f"unknown field type {field_type!r}")
    return FIELD_TYPES[kind]


def schema_of(fields: Iterable[tuple[str, str]]) -> T.StructType:
    """Schema of (name, field type) pairs."""
    return T._parse_datatype_string(", ".join(f"`{n}` {spark_type(t)}" for n, t in fields))

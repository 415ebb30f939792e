"""Type classes of the data model, read from a DataFrame schema (driver-side metadata only).

Two views of booleans are kept on purpose: cleaning treats a boolean column as numeric
(nothing to parse or impute by mode), profiling and evaluation treat it as categorical.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_nested(dt: T.DataType) -> bool:
    return isinstance(dt, NESTED_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in the profiling sense (booleans excluded)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Everything that is neither numeric nor date/time (text, boolean, nested...)."""
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and not is_datetime(f.dataType)]


def text_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if is_text(f.dataType) or (include_bool and is_bool(f.dataType))
    ]


def cleaning_numeric(dt: T.DataType) -> bool:
    """Numeric for the cleaning ladder: booleans count as numbers there."""
    return is_numeric(dt) or is_bool(dt)


def field_type(df: DataFrame, name: str) -> T.DataType:
    for f in df.schema.fields:
        if f.name == name:
            return f.dataType
    raise KeyError(name)


def type_class(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "numeric"
    if is_datetime(dt):
        return "datetime"
    return "categorical"

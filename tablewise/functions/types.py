"""Column types under nine normalized names."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int64"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "float64"),
    ((T.BooleanType,), "bool"),
    ((T.DateType,), "date"),
    ((T.TimestampType, T.TimestampNTZType), "timestamp"),
    ((T.StructType, T.MapType, T.VariantType), "json"),
    ((T.ArrayType,), "list"),
)


def normalized(kind: T.DataType) -> str:
    """The nine-name type of a Spark type; scale-0 decimals of 38 digits are integers."""
    if isinstance(kind, T.DecimalType) and kind.precision == 38 and kind.scale == 0:
        return "int64"
    return next((name for kinds, name in _NAMES if isinstance(kind, kinds)), "varchar")


def columns_of(schema: T.StructType, *names: str) -> list[str]:
    """Columns whose normalized type is one of the names."""
    return [f.name for f in schema if normalized(f.dataType) in names]


def numeric_columns(schema: T.StructType) -> list[str]:
    return columns_of(schema, "int64", "float64")


def temporal_columns(schema: T.StructType) -> list[str]:
    return columns_of(schema, "date", "timestamp")

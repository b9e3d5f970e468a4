"""Declared column types, Spark types and how values print."""

from __future__ import annotations

from pyspark.sql import types as T

from millrace.errors import MillraceError

#: SQL types of columns. VARCHAR's length is kept as metadata and never checked.
SQL_TYPES = {"int": T.IntegerType(), "integer": T.IntegerType(), "varchar": T.StringType()}
#: All value types, those that only the API reaches included.
VALUE_TYPES = {"boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(), "decimal": T.DoubleType(), "varchar": T.StringType(), "timestamp": T.TimestampType()}


def spark_type(name: str, length: int | None) -> T.DataType:
    name = name.lower()
    if name not in SQL_TYPES:
        raise MillraceError(f"unsupported type: {name}")
    if (name == "varchar") != (length is not None):
        raise MillraceError("varchar needs a length" if name == "varchar" else f"{name} takes no length")
    return SQL_TYPES[name]


def null_text(kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "varlen_null"
    if isinstance(kind, T.BooleanType):
        return "boolean_null"
    return "decimal_null" if isinstance(kind, T.DoubleType) else "integer_null"


def render(value: object, kind: T.DataType) -> str:
    if value is None:
        return null_text(kind)
    return str(value).lower() if isinstance(value, bool) else str(value)

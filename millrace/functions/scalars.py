"""Arithmetic and comparison of values with the engine's rules; all are Spark expressions under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError
from millrace.types import VALUE_TYPES


def compare(op: str, left: Column, right: Column, lk: T.DataType, rk: T.DataType) -> Column:
    """Three-valued comparison. A string on the left makes the right side a string; a string on the right is cast to a number."""
    if isinstance(lk, T.StringType) and not isinstance(rk, T.StringType):
        right = right.cast("string")
    elif isinstance(rk, T.StringType) and not isinstance(lk, T.StringType):
        right = right.cast(lk)
    return {"=": left == right, "==": left == right, "!=": left != right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def arithmetic(op: str, left: Column, right: Column, lk: T.DataType, rk: T.DataType) -> Column:
    """NULL propagates; overflow and division by zero raise; integers divide to integers."""
    if not isinstance(lk, T.NumericType) or not isinstance(rk, T.NumericType):
        raise MillraceError(f"{op} takes numbers")
    if op == "/" and isinstance(lk, T.IntegralType) and isinstance(rk, T.IntegralType):
        return F.call_function("div", left, right).cast("int")
    return {"+": left + right, "-": left - right, "*": left * right, "/": left / right, "%": left % right}[op]


def sqrt(value: Column) -> Column:
    """An error for negative values, where Spark's own gives NaN."""
    return F.when(value < 0, F.raise_error(F.lit("square root of a negative value")).cast("double")).otherwise(F.sqrt(value))


def is_zero(value: Column) -> Column:
    return value == 0


def least(a: Column, b: Column) -> Column:
    """NULL if either is NULL, unlike Spark's least."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def cast_as(value: Column, kind: str, source: T.DataType) -> Column:
    """Casts between value types; strings become booleans from true/1/t and false/0/f alone."""
    target = VALUE_TYPES[kind]
    if isinstance(source, T.StringType) and isinstance(target, T.BooleanType):
        low = F.lower(value)
        return F.when(low.isin("true", "1", "t"), True).when(low.isin("false", "0", "f"), False).when(value.isNotNull(), F.raise_error(F.lit("not a boolean")).cast("boolean"))
    return value.cast(target)

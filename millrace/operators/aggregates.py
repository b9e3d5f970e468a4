"""Aggregates. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError


def count_star() -> Column:
    return F.count(F.lit(1))


def count(value: Column, *, compat: bool = True) -> Column:
    """Number of values that aren't NULL. In compat mode NULL, not 0, where there is none."""
    n = F.count(value)
    return F.when(n > 0, n) if compat else n


def total(value: Column, kind: T.DataType | None = None) -> Column:
    """Sum; of INTEGER values it is an INTEGER, and overflow raises."""
    s = F.sum(value)
    return s.cast("int") if isinstance(kind, T.IntegerType) else s


def call(name: str, value: Column | None, kind: T.DataType | None, *, distinct: bool = False, compat: bool = True) -> Column:
    if name == "count_star":
        return count_star()
    if distinct and name == "count":
        return F.count_distinct(value)
    if distinct and name == "sum":
        s = F.sum_distinct(value)
        return s.cast("int") if isinstance(kind, T.IntegerType) else s
    if name == "count":
        return count(value, compat=compat)
    if name == "sum":
        return total(value, kind)
    own = {"min": F.min, "max": F.max, "first": F.first, "last": F.last}
    if name not in own:
        raise MillraceError(f"unknown aggregate: {name}")
    return own[name](value)


AGGREGATES = ("count", "sum", "min", "max", "first", "last")


def aggregate(df: DataFrame, keys: list[Column], outputs: list[Column]) -> DataFrame:
    """Grouped, or one row over everything if there are no keys. NULL keys make one group; no rows, no groups."""
    if keys:
        return df.groupBy(*keys).agg(*outputs) if outputs else df.select(*keys).distinct()
    return df.agg(*outputs)

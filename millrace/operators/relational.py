"""The relational operators as functions from DataFrames to DataFrames. Spark picks the physical plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError


def seq_scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A Parquet scan; filters and columns chosen later reach it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def index_scan(df: DataFrame, *keys: str) -> DataFrame:
    """All rows in ascending order of an index's columns."""
    return df.orderBy(*[F.asc_nulls_first(k) for k in keys])


def values(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns)


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true, not NULL."""
    return df.filter(predicate)


def join(left: DataFrame, right: DataFrame, on: Column | None, how: str = "inner") -> DataFrame:
    """Inner, left and the other joins; equi-keys, residual and pure theta predicates alike. NULL keys never match."""
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti", "cross"):
        raise MillraceError(f"unknown join: {how}")
    return left.crossJoin(right) if how == "cross" or on is None else left.join(right, on, how)


def index_join(left: DataFrame, right: DataFrame, on: Column, how: str = "inner", *, most_bytes: int = 64 << 20) -> DataFrame:
    """An equi-join to a keyed inner table; the inner side is broadcast if its size, as Spark estimates it, allows."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= most_bytes else right, on, how)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, *keys: Column) -> DataFrame:
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def top_n(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """The first n rows in order; Spark keeps n rows a task (TakeOrderedAndProject)."""
    return df.orderBy(*keys).limit(n)

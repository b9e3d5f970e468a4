"""Tables, indexes and virtual tables by name."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.errors import MillraceError
from millrace.sources import fixtures
from millrace.types import spark_type


@dataclass
class Column:
    name: str
    type_name: str
    length: int | None
    kind: T.DataType


@dataclass
class Table:
    oid: int
    name: str
    columns: list[Column]
    root: str
    spark: SparkSession
    parts: list[str] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind) for c in self.columns])

    def read(self, parts: list[str] | None = None) -> DataFrame:
        parts = self.parts if parts is None else parts
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)


@dataclass
class Index:
    oid: int
    name: str
    table: str
    columns: list[str]


class Catalog:
    """Names are looked up without regard to case. Indexes are metadata: Spark has no use for them and results never depend on them."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}
        self.views: dict[str, tuple[str, DataFrame | Callable[[], DataFrame]]] = {}
        self._oids = itertools.count()
        self._index_oids = itertools.count()

    def create_table(self, name: str, columns: list[tuple[str, str, int | None]]) -> Table:
        if name.lower() in self.tables or name.startswith("__"):
            raise MillraceError(f"table {name} exists or can't be made")
        if not columns or len({c.lower() for c, _, _ in columns}) < len(columns):
            raise MillraceError("columns need distinct names")
        made = [Column(c, t, n, spark_type(t, n)) for c, t, n in columns]
        table = Table(next(self._oids), name, made, f"{self.root}/{name.lower()}", self.spark)
        self.tables[name.lower()] = table
        return table

    def create_index(self, name: str, table: str, columns: list[str]) -> Index:
        owner = self.table(table)
        kinds = {c.name.lower(): c.kind for c in owner.columns}
        if not 1 <= len(columns) <= 2 or any(not isinstance(kinds.get(c.lower()), T.IntegerType) for c in columns):
            raise MillraceError("an index takes one or two integer columns")
        if name.lower() in self.indexes:
            raise MillraceError(f"index {name} exists")
        index = Index(next(self._index_oids), name, owner.name, columns)
        self.indexes[name.lower()] = index
        return index

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A read-only table, or what makes it when it is first read."""
        self.views[name.lower()] = (name, df)

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise MillraceError(f"no table {name} that can be changed")
        return self.tables[name.lower()]

    def read(self, name: str) -> DataFrame:
        key = name.lower()
        if key in self.tables:
            return self.tables[key].read()
        if key in self.views:
            own, df = self.views[key]
            if not isinstance(df, DataFrame):
                df = df()
                self.views[key] = (own, df)
            return df
        if key in fixtures.TABLES:
            return fixtures.read(self.spark, key)
        raise MillraceError(f"invalid table {name}")

    def describe_tables(self) -> DataFrame:
        """Own tables, then registered and generated ones; those have no id of their own and are numbered behind."""
        rows = [(t.oid, t.name, ", ".join(f"{c.name}:{c.type_name}" + (f"({c.length})" if c.length else "") for c in t.columns)) for t in self.tables.values()]
        oid = max((r[0] for r in rows), default=-1)
        for name in [*(n for n, _ in self.views.values()), *fixtures.TABLES]:
            oid += 1
            rows.append((oid, name, ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in self.read(name).schema)))
        return self.spark.createDataFrame(rows, "oid int, name string, cols string")

    def describe_indices(self) -> DataFrame:
        rows = [(i.table, i.oid, i.name, ", ".join(i.columns)) for i in self.indexes.values()]
        return self.spark.createDataFrame(rows, "table_name string, index_oid int, index_name string, index_cols string")

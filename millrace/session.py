"""A session: catalog, variables, and execute() for one or more statements."""

from __future__ import annotations

import html
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.errors import MillraceError
from millrace.operators import dml
from millrace.plans import explain as plans
from millrace.sql import parser
from millrace.sql.binder import Binder
from millrace.types import render

HELP = r"\dt: tables; \di: indexes; \help: this text. SELECT, INSERT, UPDATE, DELETE, CREATE TABLE, CREATE INDEX, EXPLAIN, SET, SHOW."


@dataclass
class Result:
    """Rows, or a message."""

    df: DataFrame | None = None
    message: str | None = None
    ordered: bool = False

    def rows(self) -> list[list[str]]:
        if self.df is None:
            return [[self.message]] if self.message is not None else []
        kinds = [f.dataType for f in self.df.schema]
        return [[render(v, k) for v, k in zip(r, kinds, strict=True)] for r in self.df.toLocalIterator()]


class EngineSession:
    """Tables live in Parquet folders under root, by default the warehouse's; on a cluster that must be a shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, compat: bool = True) -> None:
        self.spark = spark
        if root is None:
            root = tempfile.mkdtemp(prefix="millrace-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/millrace"
        self.catalog = Catalog(spark, root)
        self.variables: dict[str, str] = {}
        self.compat = compat

    def execute(self, sql: str) -> list[Result]:
        text = sql.strip()
        if text.startswith("\\"):
            return [self._meta(text.rstrip(";").strip())]
        return [self._run(parser.parse(s)) for s in parser.split(sql)]

    def sql(self, text: str) -> DataFrame:
        """The rows of the last statement."""
        out = self.execute(text)[-1].df
        if out is None:
            raise MillraceError("the statement has no rows")
        return out

    def _binder(self) -> Binder:
        return Binder(self.catalog, compat=self.compat)

    def _meta(self, command: str) -> Result:
        if command == r"\dt":
            return Result(self.catalog.describe_tables())
        if command == r"\di":
            return Result(self.catalog.describe_indices())
        if command == r"\help":
            return Result(message=HELP)
        raise MillraceError(f"unsupported command: {command}")

    def _count(self, name: str, n: int) -> Result:
        return Result(self.spark.createDataFrame([(n,)], f"`__mill.{name}_rows` int"))

    def _run(self, s: tuple) -> Result:
        kind = s[0]
        if kind == "select":
            return Result(self._binder().query(s[1]), ordered=bool(s[1]["order"]))
        if kind in ("insert", "delete", "update"):
            return self._count(kind, self._change(s)())
        if kind == "create_table":
            return Result(message=f"Table created with id = {self.catalog.create_table(s[1], s[2]).oid}")
        if kind == "create_index":
            return Result(message=f"Index created with id = {self.catalog.create_index(s[1], s[2], s[3]).oid}")
        if kind == "explain":
            inner = s[2]
            if inner[0] == "select":
                return Result(message=plans.explain(self._binder().query(inner[1]), inner, s[1]))
            if inner[0] in ("insert", "delete", "update"):
                return Result(message=plans.explain(self._rows(inner), inner, s[1], f"{inner[0].capitalize()} {inner[1]}"))
            return Result(message=f"=== BINDER ===\n{inner}")
        if kind == "set":
            self.variables[s[1]] = s[2]
            if s[1].lower() == "force_optimizer_starter_rule" and s[2].lower() in ("1", "true", "yes"):
                return Result(message="force_optimizer_starter_rule has no effect: Spark's optimizer plans every query")
            return Result(message="")
        return Result(message=f"{s[1]}={self.variables.get(s[1], '')}")

    def _where(self, s: tuple, table) -> Column | None:
        binder = self._binder()
        return None if s[-1] is None else binder.boolean(binder.resolve(s[-1], _Flat(table)), {})

    def _new_values(self, s: tuple, table) -> dict[str, Column]:
        binder = self._binder()
        lower = {c.name.lower(): c.name for c in table.columns}
        if any(c.lower() not in lower for c, _ in s[2]):
            raise MillraceError("no such column")
        return {lower[c.lower()]: binder.column(binder.resolve(e, _Flat(table)), {}) for c, e in s[2]}

    def _change(self, s: tuple) -> Callable[[], int]:
        """What carries out a changing statement and gives the number of rows."""
        if s[1].startswith("__"):
            raise MillraceError(f"{s[1]} can't be changed")
        table = self.catalog.table(s[1])
        if s[0] == "insert":
            rows = self._binder().query(s[2])
            return lambda: dml.insert(table, rows)
        where = self._where(s, table)
        if s[0] == "delete":
            return lambda: dml.delete(table, where)
        changes = self._new_values(s, table)
        return lambda: dml.update(table, changes, where)

    def _rows(self, s: tuple) -> DataFrame:
        """The rows that a changing statement inserts, deletes or writes anew."""
        table = self.catalog.table(s[1])
        if s[0] == "insert":
            return self._binder().query(s[2])
        where = self._where(s, table)
        hit = table.read() if where is None else table.read().where(where)
        return hit if s[0] == "delete" else hit.select(*[self._new_values(s, table).get(c, F.col(c)).alias(c) for c in hit.columns])


class _Flat:
    """Scope of one table's own columns, for UPDATE and DELETE."""

    def __init__(self, table) -> None:
        self.table = table

    def find(self, qualifier: str | None, name: str):
        from millrace.sql.binder import Name

        hit = [c for c in self.table.columns if c.name.lower() == name.lower()]
        if not hit or qualifier and qualifier.lower() != self.table.name.lower():
            raise MillraceError(f"column {name} not found")
        return Name(None, hit[0].name, hit[0].name, hit[0].kind)


# Result writers


def write_noop(result: Result) -> str:
    if result.df is not None:
        result.df.write.format("noop").mode("overwrite").save()
    return ""


def write_tabs(result: Result) -> Iterator[str]:
    for row in result.rows():
        yield "".join(f"{v}\t" for v in row)


def write_table(result: Result) -> str:
    rows = result.rows()
    head = result.df.columns if result.df is not None else [""]
    wide = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "|" + "|".join(f" {v:<{w}} " for v, w in zip(r, wide, strict=True)) + "|"
    return "\n".join([rule, line(head), rule, *map(line, rows), rule])


def write_html(result: Result) -> str:
    cells = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in r) + "</tr>"
    head = result.df.columns if result.df is not None else []
    return f"<table>{cells('th', head)}{''.join(cells('td', r) for r in result.rows())}</table>"

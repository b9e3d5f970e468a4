"""Statements to DataFrames. Every input column gets a name of its own, so that qualifiers survive any nesting of joins."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog import Catalog
from millrace.errors import MillraceError
from millrace.functions import scalars, strings
from millrace.operators import aggregates, relational


@dataclass(frozen=True)
class Name:
    qualifier: str | None
    name: str
    own: str
    kind: T.DataType


class Scope:
    def __init__(self, df: DataFrame, names: list[Name]) -> None:
        self.df, self.names = df, names

    def find(self, qualifier: str | None, name: str) -> Name:
        hits = [n for n in self.names if n.name.lower() == name.lower() and (qualifier is None or (n.qualifier or "").lower() == qualifier.lower())]
        if len(hits) != 1:
            raise MillraceError(f"column {name} is {'ambiguous' if hits else 'not found'}")
        return hits[0]


class Binder:
    def __init__(self, catalog: Catalog, *, compat: bool = True) -> None:
        self.catalog, self.compat = catalog, compat
        self.own = itertools.count()
        self.items = itertools.count()

    # FROM

    def named(self, df: DataFrame, qualifier: str | None, names: list[str] | None = None) -> Scope:
        names = names or df.columns
        if len(names) != len(df.columns):
            raise MillraceError("wrong number of column names")
        own = [f"_c{next(self.own)}" for _ in names]
        kinds = [f.dataType for f in df.schema]
        return Scope(df.toDF(*own), [Name(qualifier, n, o, k) for n, o, k in zip(names, own, kinds, strict=True)])

    def source(self, t: tuple, ctes: dict[str, dict]) -> Scope:
        if t[0] == "table":
            _, name, alias = t
            if name.lower() in ctes:
                return self.named(self.query(ctes[name.lower()], {}), alias or name)
            return self.named(self.catalog.read(name), alias or name)
        if t[0] == "subquery":
            return self.named(self.query(t[1], ctes), t[2], t[3])
        _, how, left, right, on = t
        a, b = self.source(left, ctes), self.source(right, ctes)
        both = Scope(a.df, a.names + b.names)
        condition = None if on is None else self.boolean(self.resolve(on, both), {})
        return Scope(relational.join(a.df, b.df, condition, how), both.names)

    def sources(self, tables: list[tuple] | None, ctes: dict[str, dict]) -> Scope:
        if tables is None:
            return Scope(self.catalog.spark.range(1).select(), [])
        scopes = [self.source(t, ctes) for t in tables]
        aliases = [n.qualifier.lower() for s in scopes for n in s.names[:1] if n.qualifier]
        if len(set(aliases)) < len(aliases):
            raise MillraceError("a table name is used twice")
        out = scopes[0]
        for s in scopes[1:]:
            out = Scope(relational.join(out.df, s.df, None, "cross"), out.names + s.names)
        return out

    # Expressions: resolve() replaces columns by their own names; column() makes Spark expressions.

    def resolve(self, e: tuple | None, scope: Scope) -> tuple | None:
        if not isinstance(e, tuple):
            return e
        if e and e[0] == "col":
            n = scope.find(e[1], e[2])
            return ("own", n.own, n.kind)
        return tuple(self.resolve(x, scope) for x in e)

    def kind(self, e: tuple, known: dict[tuple, tuple[str, T.DataType]]) -> T.DataType:
        if e in known:
            return known[e][1]
        if e[0] == "own":
            return e[2]
        if e[0] == "const":
            return T.StringType() if isinstance(e[1], str) else T.BooleanType() if isinstance(e[1], bool) else T.IntegerType()
        if e[0] == "call":
            return T.StringType()
        if e[0] == "minus":
            return self.kind(e[1], known)
        if e[0] == "math":
            a, b = self.kind(e[2], known), self.kind(e[3], known)
            order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()]
            return max((k for k in (a, b) if k in order), key=order.index, default=T.IntegerType())
        return T.BooleanType()

    def column(self, e: tuple, known: dict[tuple, tuple[str, T.DataType]]) -> Column:
        if e in known:
            return F.col(known[e][0])
        op = e[0]
        if op == "own":
            return F.col(e[1])
        if op == "const":
            return F.lit(e[1]).cast("int") if e[1] is None or isinstance(e[1], int) and not isinstance(e[1], bool) and abs(e[1]) < 2**31 else F.lit(e[1])
        if op in ("and", "or"):
            a, b = (self.boolean(x, known) for x in e[1:])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.boolean(e[1], known)
        if op == "null":
            return self.column(e[1], known).isNull()
        if op == "minus":
            return -self.column(e[1], known)
        if op == "call":
            return strings.call(e[1], [self.column(x, known) for x in e[2]], [self.kind(x, known) for x in e[2]])
        if op in ("compare", "math"):
            a, b = (self.column(x, known) for x in e[2:])
            made = scalars.compare if op == "compare" else scalars.arithmetic
            return made(e[1], a, b, self.kind(e[2], known), self.kind(e[3], known))
        if op == "agg":
            raise MillraceError("an aggregate can't stand here")
        raise MillraceError(f"{op} can't stand here")

    def boolean(self, e: tuple, known: dict[tuple, tuple[str, T.DataType]]) -> Column:
        if not isinstance(self.kind(e, known), T.BooleanType) and e != ("const", None):
            raise MillraceError("a condition must be boolean")
        c = self.column(e, known)
        return c.cast("boolean") if e == ("const", None) else c

    def aggregates_in(self, e: tuple | None) -> list[tuple]:
        if not isinstance(e, tuple):
            return []
        if e and e[0] == "agg":
            if self.aggregates_in(e[2]):
                raise MillraceError("aggregates can't be nested")
            return [e]
        return [a for x in e for a in self.aggregates_in(x)]

    # Queries

    def values(self, q: dict) -> DataFrame:
        rows = q["values"]
        if len({len(r) for r in rows}) != 1:
            raise MillraceError("rows differ in length")
        empty = Scope(self.catalog.spark.range(1), [])
        bound = [[self.resolve(e, empty) for e in r] for r in rows]
        kinds = []
        for column in zip(*bound, strict=True):
            own = {self.kind(e, {}) for e in column if e != ("const", None)} or {T.IntegerType()}
            if len(own) > 1:
                raise MillraceError("a column of VALUES has more than one type")
            kinds.append(own.pop())
        plain = lambda e: e[1] if e[0] == "const" else -e[1][1] if e[0] == "minus" and e[1][0] == "const" else None
        if all(e[0] == "const" or e[0] == "minus" and e[1][0] == "const" for r in bound for e in r):
            schema = T.StructType([T.StructField(f"__item#{i}", k) for i, k in enumerate(kinds)])
            return relational.values(self.catalog.spark, [tuple(plain(e) for e in r) for r in bound], schema)
        one = self.catalog.spark.range(1)
        row = lambda r: F.struct(*[self.column(e, {}).cast(k).alias(f"__item#{i}") for i, (e, k) in enumerate(zip(r, kinds, strict=True))])
        return one.select(F.inline(F.array(*[row(r) for r in bound])))

    def query(self, q: dict, outer: dict[str, dict] | None = None) -> DataFrame:
        """A WITH item sees those before it; each use of it is planned anew, and Spark reuses equal exchanges."""
        ctes = dict(outer or {})
        for name, sub in q["ctes"]:
            ctes[name.lower()] = sub | {"ctes": [*[(n, s) for n, s in ctes.items() if n != name.lower()], *sub["ctes"]]}
        if "values" in q:
            return self.values(q)
        scope = self.sources(q["from"], ctes)
        df = scope.df
        if q["where"] is not None:
            df = relational.filter_rows(df, self.boolean(self.resolve(q["where"], scope), {}))
        items: list[tuple[tuple, str | None]] = []
        for e, alias in q["items"]:
            if e[0] == "star":
                if len(q["items"]) > 1 and e[1] is None:
                    raise MillraceError("* can't be mixed with other items")
                found = [n for n in scope.names if e[1] is None or (n.qualifier or "").lower() == e[1].lower()]
                if not found:
                    raise MillraceError("nothing to select from")
                items += [(("own", n.own, n.kind), n.name) for n in found]
            else:
                items.append((self.resolve(e, scope), alias or (e[2] if e[0] == "col" else None)))
        labels = [alias.lower() if alias else None for _, alias in items]
        order = []
        for e, down, last in q["order"]:
            if e[0] == "col" and e[1] is None and labels.count(e[2].lower()) == 1:
                order.append((items[labels.index(e[2].lower())][0], down, last))
            else:
                order.append((self.resolve(e, scope), down, last))
        having = self.resolve(q["having"], scope)
        groups = [self.resolve(e, scope) for e in q["group"]]
        found = list(dict.fromkeys(a for e in [*[e for e, _ in items], having, *[e for e, _, _ in order]] for a in self.aggregates_in(e)))
        known: dict[tuple, tuple[str, T.DataType]] = {}
        if groups or found or having is not None:
            keys, outputs = [], []
            for i, g in enumerate(dict.fromkeys(groups)):
                keys.append(self.column(g, {}).alias(f"_g{i}"))
                known[g] = (f"_g{i}", self.kind(g, {}))
            for i, a in enumerate(found):
                _, name, arg, single = a
                kind = None if arg is None else self.kind(arg, {})
                value = None if arg is None else self.column(arg, {})
                outputs.append(aggregates.call(name, value, kind, distinct=single, compat=self.compat).alias(f"_a{i}"))
                known[a] = (f"_a{i}", T.LongType() if name in ("count", "count_star") else kind)
            df = aggregates.aggregate(df, keys, outputs)
            for e in [*[e for e, _ in items], having, *[e for e, _, _ in order]]:
                if loose := self.loose(e, known):
                    raise MillraceError(f"column {loose} must be grouped or aggregated")
            if having is not None:
                df = relational.filter_rows(df, self.boolean(having, known))
        names = [alias or f"__item#{next(self.items)}" for _, alias in items]
        outputs = [self.column(e, known).alias(f"_o{i}") for i, (e, _) in enumerate(items)]
        extra = [e for e, _, _ in order if e not in [x for x, _ in items]]
        if extra and q["distinct"]:
            raise MillraceError("ORDER BY of a DISTINCT query must be selected")
        df = relational.project(df, *outputs, *[self.column(e, known).alias(f"_s{i}") for i, e in enumerate(extra)])
        if q["distinct"]:
            df = relational.distinct(df)
        if order:
            at = [x for x, _ in items]
            keys = []
            for e, down, last in order:
                c = F.col(f"_o{at.index(e)}" if e in at else f"_s{extra.index(e)}")
                last = down if last is None else last
                keys.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if down else (c.asc_nulls_last() if last else c.asc_nulls_first()))
            df = relational.top_n(df, q["limit"], *keys) if q["limit"] is not None else relational.sort(df, *keys)
        elif q["limit"] is not None:
            df = relational.limit(df, q["limit"])
        return df.drop(*[f"_s{i}" for i in range(len(extra))]).toDF(*names) if extra else df.toDF(*names)

    def loose(self, e: tuple | None, known: dict) -> str | None:
        if not isinstance(e, tuple) or e in known:
            return None
        if e and e[0] == "own":
            return e[1]
        return next((x for x in (self.loose(x, known) for x in e) if x), None)

"""A recursive-descent parser. Statements and expressions come out as tuples, the kind first."""

from __future__ import annotations

import re

from millrace.errors import MillraceError
from millrace.operators.aggregates import AGGREGATES

TOKEN = re.compile(r"\s+|--[^\n]*|(?P<num>\d+(?:\.\d+)?)|(?P<id>[A-Za-z_][A-Za-z_0-9]*)|\"(?P<qid>[^\"]+)\"|'(?P<str>(?:[^']|'')*)'|(?P<op><>|!=|<=|>=|==|[-+*/%=<>(),.;])")
RESERVED = {"select", "from", "where", "group", "having", "order", "limit", "offset", "on", "join", "inner", "left", "right", "full", "outer", "cross", "as", "and", "or", "not", "by", "asc", "desc", "union", "intersect", "except", "set", "values", "with", "distinct", "is", "nulls", "using"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise MillraceError(f"cannot read {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            value = m[m.lastgroup]
            out.append((m.lastgroup, value.replace("''", "'") if m.lastgroup == "str" else value))
    return [*out, ("end", "")]


def split(text: str) -> list[list[tuple[str, str]]]:
    """The tokens of each statement of a text."""
    out: list[list[tuple[str, str]]] = [[]]
    for t in tokens(text)[:-1]:
        if t == ("op", ";"):
            out.append([])
        else:
            out[-1].append(t)
    return [[*s, ("end", "")] for s in out if s]


class Parser:
    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.items, self.at = items, 0

    # Tokens

    def word(self, ahead: int = 0) -> str:
        kind, value = self.items[min(self.at + ahead, len(self.items) - 1)]
        return value.lower() if kind in ("id", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise MillraceError(f"expected {' '.join(words).upper()} before {self.items[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.items[self.at]
        if kind not in ("id", "qid") or kind == "id" and value.lower() in RESERVED:
            raise MillraceError(f"expected a name before {value!r}")
        self.at += 1
        return value

    def number(self) -> int:
        kind, value = self.items[self.at]
        if kind != "num" or "." in value:
            raise MillraceError("expected an integer")
        self.at += 1
        return int(value)

    def several(self, part) -> list:
        out = [part()]
        while self.take(","):
            out.append(part())
        return out

    def done(self) -> None:
        if self.items[self.at][0] != "end":
            raise MillraceError(f"cannot go on at {self.items[self.at][1]!r}")

    # Statements

    def statement(self) -> tuple:
        out = self._statement()
        self.done()
        return out

    def _statement(self) -> tuple:
        w = self.word()
        if w in ("select", "with", "values", "("):
            return ("select", self.query())
        if w == "explain":
            self.at += 1
            modes = []
            if self.take("("):
                modes = [m.lower() for m in self.several(self.name)]
                self.need(")")
            return ("explain", modes, self._statement())
        if w == "show":
            self.at += 1
            return ("show", self.name())
        if self.take("set"):
            name = self.name()
            if not self.take("="):
                self.need("to")
            value = self.items[self.at][1]
            self.at += 1
            return ("set", name, value)
        if self.take("create", "table"):
            return self.create_table()
        if self.take("create", "index"):
            name = self.name()
            self.need("on")
            table = self.name()
            self.need("(")
            columns = self.several(self.name)
            self.need(")")
            return ("create_index", name, table, columns)
        if self.take("insert", "into"):
            return ("insert", self.name(), self.query())
        if self.take("delete", "from"):
            return ("delete", self.name(), self.expression() if self.take("where") else None)
        if self.take("update"):
            table = self.name()
            self.need("set")
            changes = self.several(self.change)
            return ("update", table, changes, self.expression() if self.take("where") else None)
        raise MillraceError(f"no such statement: {self.items[self.at][1]!r}")

    def change(self) -> tuple:
        name = self.name()
        self.need("=")
        return name, self.expression()

    def create_table(self) -> tuple:
        name = self.name()
        self.need("(")

        def column() -> tuple:
            column, kind, length = self.name(), self.name(), None
            if self.take("("):
                length = self.number()
                self.need(")")
            return column, kind.lower(), length

        columns = self.several(column)
        self.need(")")
        return ("create_table", name, columns)

    # Queries

    def query(self) -> dict:
        ctes = []
        if self.take("with"):
            if self.word() == "recursive":
                raise MillraceError("recursive CTEs are not supported")
            ctes = self.several(self.cte)
        if self.word() == "(":
            self.need("(")
            out = self.query()
            self.need(")")
            return out | {"ctes": ctes + out["ctes"]}
        if self.take("values"):
            return {"ctes": ctes, "values": self.several(self.row), "order": [], "limit": None}
        self.need("select")
        q: dict = {"ctes": ctes, "distinct": self.take("distinct"), "from": None, "where": None, "group": [], "having": None, "order": [], "limit": None}
        if q["distinct"] and self.word() == "on":
            raise MillraceError("DISTINCT ON is not supported")
        q["items"] = [self.item()]
        while self.take(","):
            if self.word() == "from" or self.items[self.at][0] == "end":
                break  # a comma may trail
            q["items"].append(self.item())
        if self.take("from"):
            q["from"] = self.several(self.table_expression)
        if self.take("where"):
            q["where"] = self.expression()
        if self.take("group", "by"):
            q["group"] = self.several(self.expression)
        if self.take("having"):
            q["having"] = self.expression()
        if self.take("order", "by"):
            q["order"] = self.several(self.order)
        if self.take("limit"):
            q["limit"] = self.number()
        if self.word() in ("offset", "union", "intersect", "except"):
            raise MillraceError(f"{self.word().upper()} is not supported")
        return q

    def cte(self) -> tuple:
        name = self.name()
        self.need("as")
        self.need("(")
        q = self.query()
        self.need(")")
        return name, q

    def row(self) -> list:
        self.need("(")
        out = self.several(self.expression)
        self.need(")")
        return out

    def item(self) -> tuple:
        if self.take("*"):
            return ("star", None), None
        if self.items[self.at][0] == "id" and self.word(1) == "." and self.word(2) == "*":
            qualifier = self.name()
            self.at += 2
            return ("star", qualifier), None
        e = self.expression()
        if self.take("as"):
            return e, self.name()
        return e, self.name() if self.items[self.at][0] in ("id", "qid") and self.word() not in RESERVED else None

    def order(self) -> tuple:
        e = self.expression()
        down = self.take("desc")
        if not down:
            self.take("asc")
        last = None
        if self.take("nulls", "first"):
            last = False
        elif self.take("nulls", "last"):
            last = True
        return e, down, last

    def table_expression(self) -> tuple:
        left = self.table_primary()
        while True:
            how = None
            if self.take("cross", "join"):
                left = ("join", "cross", left, self.table_primary(), None)
                continue
            if self.take("inner", "join") or self.take("join"):
                how = "inner"
            for kind in ("left", "right", "full"):
                if self.take(kind, "outer", "join") or self.take(kind, "join"):
                    how = kind
            if not how:
                return left
            right = self.table_primary()
            self.need("on")
            left = ("join", how, left, right, self.expression())

    def table_primary(self) -> tuple:
        if self.take("("):
            if self.word() in ("select", "with", "values"):
                q = self.query()
                self.need(")")
                return ("subquery", q, *self.alias())
            inner = self.table_expression()
            self.need(")")
            return inner
        name = self.name()
        return ("table", name, self.alias()[0])

    def alias(self) -> tuple:
        took = self.take("as")
        if took or self.items[self.at][0] in ("id", "qid") and self.word() not in RESERVED:
            name, columns = self.name(), None
            if self.take("("):
                columns = self.several(self.name)
                self.need(")")
            return name, columns
        return None, None

    # Expressions

    def expression(self) -> tuple:
        e = self.conjunction()
        while self.take("or"):
            e = ("or", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.take("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        e = self.sum()
        while True:
            if self.word() in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                op = self.word()
                self.at += 1
                e = ("compare", op, e, self.sum())
            elif self.take("is", "not", "null"):
                e = ("not", ("null", e))
            elif self.take("is", "null"):
                e = ("null", e)
            else:
                return e

    def sum(self) -> tuple:
        e = self.product()
        while self.word() in ("+", "-"):
            op = self.word()
            self.at += 1
            e = ("math", op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.word() in ("*", "/", "%"):
            op = self.word()
            self.at += 1
            e = ("math", op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("-"):
            return ("minus", self.unary())
        return self.unary() if self.take("+") else self.primary()

    def primary(self) -> tuple:
        kind, value = self.items[self.at]
        if kind == "num":
            if "." in value:
                raise MillraceError(f"unsupported literal {value}")
            self.at += 1
            return ("const", int(value))
        if kind == "str":
            self.at += 1
            return ("const", value)
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.word() in ("null", "true", "false"):
            self.at += 1
            return ("const", {"null": None, "true": True, "false": False}[value.lower()])
        name = self.name()
        if self.take("("):
            low = name.lower()
            if low == "count" and self.take("*"):
                self.need(")")
                return ("agg", "count_star", None, False)
            single = self.take("distinct")
            args = [] if self.word() == ")" else self.several(self.expression)
            self.need(")")
            if low in AGGREGATES:
                if len(args) != 1:
                    raise MillraceError(f"{low} takes one argument")
                return ("agg", low, args[0], single)
            return ("call", low, tuple(args))
        if self.take("."):
            return ("col", name, self.name())
        return ("col", None, name)


def parse(items: list[tuple[str, str]]) -> tuple:
    return Parser(items).statement()

"""lower and upper that take exactly one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MillraceError

STRING_FUNCTIONS = {"lower": F.lower, "upper": F.upper}


def call(name: str, args: list[Column], kinds: list[T.DataType]) -> Column:
    """Spark would cast a number to a string here; this is an error instead."""
    if name not in STRING_FUNCTIONS:
        raise MillraceError(f"unknown function: {name}")
    if len(args) != 1 or not isinstance(kinds[0], T.StringType):
        raise MillraceError(f"{name} takes one varchar")
    return STRING_FUNCTIONS[name](args[0])

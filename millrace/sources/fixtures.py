"""Generated tables: each column is an expression over spark.range, so any size is made by all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The two symbols that string columns hold, and the staff tables' days.
POO, ANGEL = "\U0001f4a9", "\U0001f607"
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
HOURS_2022 = ["Tuesday", "Wednesday", "Monday", "Wednesday", "Thursday", "Friday", "Wednesday", "Randomly", "Tuesday", "Monday", "Tuesday"]
HOURS_2023 = ["Friday", "Thursday", "Tuesday", "Monday", "Tuesday", "Tuesday", "Randomly", "Wednesday", "Thursday"]


def c():
    return F.col("id")


def _int(e):
    return e.cast("int")


def _days(ids: list[int]):
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), _int(c()) + 1), F.when(c().isin(ids), 1).otherwise(0)


def _staff(hours: list[str]):
    """Ids are numbered: no query depends on the names of persons."""
    return {"github_id": F.concat(F.lit("staff"), c().cast("string")), "office_hour": F.element_at(F.array(*[F.lit(h) for h in hours]), _int(c()) + 1)}


def _agg(step: int, wide: int):
    return lambda: {"v1": _int((c() + 2) % 10), "v2": _int(c()), "v3": _int((c() + 50) % 100), "v4": _int(F.floor(c() / step)), "v5": F.lit(233), "v6": F.repeat(F.lit(POO), _int(c() % wide) + 1)}


def _pair(shift: int):
    k = lambda: (c() + shift) % 500_000
    return lambda: {"x": _int(k()), "y": _int(k() * 10)}


#: Name: rows, and columns by name.
TABLES = {
    "__mock_table_1": (100, lambda: {"colA": _int(c()), "colB": _int(c() * 100)}),
    "__mock_table_2": (100, lambda: {"colC": F.concat(c().cast("string"), F.lit("-" + POO)), "colD": F.repeat(F.lit(ANGEL), _int(c() % 8))}),
    "__mock_table_3": (100, lambda: {"colE": F.when(c() % 2 == 0, _int(c())), "colF": F.concat(c().cast("string"), F.lit("-" + POO))}),
    "__mock_table_tas_2022": (11, lambda: _staff(HOURS_2022)),
    "__mock_table_tas_2023": (9, lambda: _staff(HOURS_2023)),
    "__mock_table_schedule_2022": (7, lambda: dict(zip(("day_of_week", "has_lecture"), _days([1, 3]), strict=True))),
    "__mock_table_schedule_2023": (7, lambda: dict(zip(("day_of_week", "has_lecture"), _days([0, 2]), strict=True))),
    "__mock_agg_input_small": (1_000, _agg(100, 8)),
    "__mock_agg_input_big": (10_000, _agg(1_000, 16)),
    "__mock_table_123": (3, lambda: {"number": _int(c()) + 1}),
    "__mock_graph": (100, lambda: {"src": _int(c() % 10), "dst": _int(F.floor(c() / 10)), "src_label": F.lpad((c() % 10).cast("string"), 3, "0"), "dst_label": F.lpad(F.floor(c() / 10).cast("string"), 3, "0"), "distance": F.when(c() % 10 != F.floor(c() / 10), 1)}),
    "__mock_t1": (1_000_000, lambda: {"x": _int(F.floor(c() / 10_000)), "y": _int(c() % 10_000), "z": _int(c())}),
    "__mock_t4_1m": (1_000_000, _pair(0)),
    "__mock_t5_1m": (1_000_000, _pair(30_000)),
    "__mock_t6_1m": (1_000_000, _pair(60_000)),
    "__mock_t7": (1_000_000, lambda: {"v": _int(c() % 20), "v1": _int(c()), "v2": _int(c())}),
    "__mock_t8": (10, lambda: {"v4": _int(c())}),
    "empty_table": (0, lambda: {"colA": _int(c())}),
    "test_simple_seq_1": (10, lambda: {"col1": _int(c())}),
    "test_simple_seq_2": (10, lambda: {"col1": _int(c()), "col2": _int(c()) + 10}),
    "test_1": (1_000, lambda: {"colA": _int(c()), "colB": uniform(0, 9, 1), "colC": uniform(0, 9_999, 2), "colD": uniform(0, 99_999, 3)}),
    "test_2": (100, lambda: {"colA": _int(c()), "colB": uniform(0, 999, 4), "colC": cyclic(0, 9)}),
}


def serial(start: int = 0):
    return _int(c()) + start


def uniform(low: int, high: int, seed: int):
    """Seeded by row, so any partitioning gives the same rows."""
    return _int(F.lit(low) + F.pmod(F.xxhash64(c(), F.lit(seed)), F.lit(high - low + 1)))


def cyclic(low: int, high: int):
    return _int(F.lit(low) + c() % (high - low + 1))


def read(spark: SparkSession, name: str, rows: int | None = None) -> DataFrame:
    n, columns = TABLES[name.lower()]
    return spark.range(n if rows is None else rows).select(*[e.alias(k) for k, e in columns().items()])

"""Insert, delete and update over versioned Parquet snapshots.

A table is a list of immutable Parquet folders. Each statement writes a new folder and then swaps the list, so a statement
reads its own table as it was, and one that fails changes nothing. Inserts count rows as they write them. Deletes and updates
first count the rows they hit in each folder, by a scan of the predicate's columns alone, and then write anew only folders
with such rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.catalog import Table
from millrace.errors import MillraceError

#: An insert that would make more folders than this rewrites the table as one.
MOST_PARTS = 64


def _check(table: Table, rows: DataFrame) -> DataFrame:
    kinds = [f.dataType for f in rows.schema]
    if kinds != [c.kind for c in table.columns]:
        raise MillraceError("table schema mismatch")
    return rows.toDF(*[c.name for c in table.columns])


def _write(table: Table, df: DataFrame) -> str:
    path = f"{table.root}/v={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _counted(df: DataFrame, what: Column) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.coalesce(F.sum(what.cast("long")), F.lit(0)).alias("n")), seen


def insert(table: Table, rows: DataFrame) -> int:
    rows = _check(table, rows)
    whole = len(table.parts) >= MOST_PARTS
    df, seen = _counted(rows, F.lit(1))
    parts = [*table.parts, _write(table, df)]
    n = seen.get["n"]
    table.parts = [_write(table, table.read(parts))] if whole else parts
    return n


def _split(table: Table, hit: Column) -> tuple[int, list[str], list[str]]:
    """Rows hit, folders with such rows, and the other folders."""
    if not table.parts:
        return 0, [], []
    name = F.regexp_extract(F.col("_metadata.file_path"), "(v=[0-9a-f]+)/[^/]*$", 1)
    seen = {r["part"]: r["count"] for r in table.read().where(hit).groupBy(name.alias("part")).count().collect()}
    touched = [p for p in table.parts if p.rsplit("/", 1)[1] in seen]
    return sum(seen.values()), touched, [p for p in table.parts if p not in touched]


def delete(table: Table, predicate: Column | None) -> int:
    """Rows for which the predicate is true go; no predicate, all rows."""
    if predicate is None:
        n, table.parts = table.read().count(), []
        return n
    hit = F.coalesce(predicate, F.lit(False))
    n, touched, rest = _split(table, hit)
    if touched:
        table.parts = [*rest, _write(table, table.read(touched).where(~hit))]
    return n


def update(table: Table, changes: dict[str, Column], predicate: Column | None) -> int:
    """All new values are computed from the old row."""
    hit = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    n, touched, rest = _split(table, hit)
    if touched:
        old = table.read(touched).withColumn("__hit", hit)
        new = old.select(*[F.when(F.col("__hit"), changes[c.name]).otherwise(F.col(c.name)).cast(c.kind).alias(c.name) if c.name in changes else F.col(c.name) for c in table.columns])
        table.parts = [*rest, _write(table, new)]
    return n

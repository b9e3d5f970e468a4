"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from millrace import workloads

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(workloads.ORACLE))
def test_query(spark, duck, name):
    df = workloads.QUERIES[name](spark, SF)
    got = duck.execute(workloads.ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key([tuple(plain(r[c]) for c in names) for r in df.collect()]) == key([tuple(plain(v) for v in r) for r in got.fetchall()])

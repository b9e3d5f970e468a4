from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace import session, slt
from millrace.errors import MillraceError
from millrace.functions import scalars
from millrace.operators import relational
from millrace.plans import explain
from millrace.sources import fixtures


@pytest.mark.parametrize("path", sorted((Path(__file__).parent / "slt").glob("*.slt")), ids=lambda p: p.stem)
def test_golden(spark, path):
    assert slt.run(session.EngineSession(spark), path) == []


@pytest.mark.parametrize("text", ["select upper(1)", "select lower('a', 'b')", "select a from (values (1)) as v(x)", "select v1 from __nowhere", "insert into __mock_t8 values (1)", "select 1.5", "select * from __mock_t8 limit 1 offset 2", "create table t (a float)", "create table t (a varchar)", "select max(max(v4)) from __mock_t8", "select v4, count(*) from __mock_t8", r"\x"])
def test_errors(spark, text):
    with pytest.raises(MillraceError):
        session.EngineSession(spark).execute(text)


def test_ambiguous_and_mismatch(spark):
    s = session.EngineSession(spark)
    s.execute("create table t (a int, s varchar(4))")
    for text in ("select a from t x, t y", "insert into t values ('x', 1)", "create table T (a int)", "create index i on t (s)", "update t set b = 1"):
        with pytest.raises(MillraceError):
            s.execute(text)


def test_failed_statement_changes_nothing(spark):
    s = session.EngineSession(spark)
    s.execute("create table t (a int); insert into t values (1), (2)")
    with pytest.raises(Exception):
        s.execute("update t set a = a + 2147483647")
    assert s.execute("select a from t order by a")[0].rows() == [["1"], ["2"]]


def test_many_inserts_are_compacted(spark, monkeypatch):
    from millrace.operators import dml

    monkeypatch.setattr(dml, "MOST_PARTS", 3)
    s = session.EngineSession(spark)
    s.execute("create table t (a int)")
    for k in range(5):
        s.execute(f"insert into t values ({k})")
    assert len(s.catalog.table("t").parts) <= 3
    assert [r[0] for r in s.execute("select a from t order by a")[0].rows()] == list("01234")


def test_plans(spark):
    s = session.EngineSession(spark)
    assert explain.count(s.sql("select x from __mock_t1 order by x limit 3"), "topn") == 1
    assert explain.count(s.sql("select a.x from __mock_t4_1m a inner join __mock_t5_1m b on a.x = b.x"), "hash_join") == 1
    assert explain.count(s.sql("select number from __mock_table_123 inner join __mock_t8 on number < v4"), "nlj") == 1


def test_writers(spark):
    s = session.EngineSession(spark)
    r = s.execute("select 1 as a, null as b")[0]
    assert list(session.write_tabs(r)) == ["1\tinteger_null\t"]
    assert "<td>1</td>" in session.write_html(r) and "integer_null" in session.write_table(r) and session.write_noop(r) == ""


def test_values_api(spark):
    df = spark.createDataFrame([(4.0, "t"), (None, None)], "x double, s string")
    rows = df.select(scalars.sqrt(F.col("x")), scalars.cast_as(F.col("s"), "boolean", df.schema["s"].dataType), scalars.least(F.col("x"), F.lit(1.0))).collect()
    assert [tuple(r) for r in rows] == [(2.0, True, 1.0), (None, None, None)]


def test_generators_do_not_depend_on_partitioning(spark):
    one = fixtures.read(spark, "test_1").coalesce(1).collect()
    assert sorted(one) == sorted(fixtures.read(spark, "test_1").repartition(7).collect())


def test_cross_and_semi(spark):
    a = spark.range(3)
    b = spark.range(2).toDF("k")
    assert relational.join(a, b, None).count() == 6
    assert relational.join(a, b, a.id == b.k, "left_anti").count() == 1


def test_changes_leave_untouched_folders(spark):
    s = session.EngineSession(spark)
    s.execute("create table t (a int, b int)")
    for k in range(3):
        s.execute(f"insert into t values ({k}, 0), ({k + 10}, 1)")
    before = list(s.catalog.table("t").parts)
    assert s.execute("update t set b = 5 where a = 1")[0].rows() == [["1"]]
    after = s.catalog.table("t").parts
    assert after[:2] == [before[0], before[2]] and before[1] not in after
    assert s.execute("delete from t where a = 99")[0].rows() == [["0"]] and s.catalog.table("t").parts == after
    assert s.execute("delete from t where b = 5 or a = 2")[0].rows() == [["2"]]
    assert s.execute("select a, b from t order by a")[0].rows() == [["0", "0"], ["10", "1"], ["11", "1"], ["12", "1"]]
    assert s.execute("delete from t")[0].rows() == [["4"]] and s.catalog.table("t").parts == []


def test_explain_of_changes(spark):
    s = session.EngineSession(spark)
    s.execute("create table t (a int, b int); insert into t values (1, 2)")
    for text, head in (("insert into t select b, a from t", "Insert t"), ("delete from t where a = 1", "Delete t"), ("update t set a = b + 1", "Update t")):
        said = s.execute(f"explain {text}")[0].message
        assert said.count(head) == 3 and all(f"=== {h} ===" in said for h in ("BINDER", "PLANNER", "OPTIMIZER", "SCHEMA"))
    assert s.execute("select a, b from t")[0].rows() == [["1", "2"]]


def test_names_and_variables(spark):
    s = session.EngineSession(spark)
    assert s.sql("select 1 + 1, 2 as x, v4 - 1 from __mock_t8 limit 1").columns == ["__item#0", "x", "__item#1"]
    assert "no effect" in s.execute("set force_optimizer_starter_rule = yes")[0].message
    assert s.execute("show force_optimizer_starter_rule")[0].message == "force_optimizer_starter_rule=yes"
    names = [r[1] for r in s.execute(r"\dt")[0].rows()]
    assert {"__mock_table_1", "test_simple_seq_2", "__mock_t8"} <= set(names)


def test_entry_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", "import __spark_entry__ as e; print(len(e.queries()) == len(e.oracle_sql()) > 70, 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["True", "False"]

"""The registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import MillraceError
from millrace.functions import scalars, strings
from millrace.operators import aggregates as agg
from millrace.operators import relational as op
from millrace.plans import explain as plans
from millrace.session import EngineSession
from millrace.sources import fixtures

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def session(spark: SparkSession, sf_dir: str) -> EngineSession:
    """An engine session in which the driver's tables are read-only tables."""
    s = EngineSession(spark)
    for t in TABLES:
        s.catalog.register(t, partial(spark.read.parquet, f"{sf_dir}/{t}.parquet"))
    return s


def dialect(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's own SQL. text may have several statements; the last one's rows count."""
    QUERIES[name] = lambda spark, sf_dir: session(spark, sf_dir).sql(text)
    ORACLE[name] = oracle or text


def frame(name: str, oracle: str) -> Callable:
    """A query of the DataFrame operators."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        ORACLE[name] = oracle
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return op.seq_scan(spark, f"{sf_dir}/{table}.parquet", *columns)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, group, the five aggregates and a sort over lineitem."""
    rows = op.filter_rows(_t(spark, sf_dir, "lineitem"), F.col("l_quantity") <= 45)
    outputs = [agg.count_star().alias("n"), F.sum(F.col("l_linenumber")).alias("lines"), F.min("l_quantity").alias("low"), F.max("l_extendedprice").alias("high"), F.count("l_tax").alias("taxed")]
    return op.sort(agg.aggregate(rows, [F.col("l_returnflag"), F.col("l_linestatus")], outputs), F.asc_nulls_first("l_returnflag"), F.asc_nulls_first("l_linestatus"))


QUERIES["flagship"] = flagship
ORACLE["flagship"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines, min(l_quantity) AS low, max(l_extendedprice) AS high, count(l_tax) AS taxed FROM lineitem WHERE l_quantity <= 45 GROUP BY 1, 2"

# Scans, projection, values
dialect("scan_project", "SELECT n_nationkey AS k, n_name AS name FROM nation")
dialect("select_star", "SELECT * FROM region")
dialect("project_arith", "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS plus, l_linenumber - 1 AS minus FROM lineitem")
dialect("unary_and_product", "SELECT n_nationkey, -n_nationkey AS neg, n_nationkey * 3 AS thrice, NOT n_regionkey = 1 AS other FROM nation")
dialect("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS v(x, y)")


@frame("index_scan", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf_dir):
    return op.index_scan(_t(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_custkey")


@frame("mock_scan", "SELECT (i + 2) % 10 AS v1, i AS v2, (i + 50) % 100 AS v3, i // 100 AS v4, 233 AS v5, repeat(chr(128169), (i % 8 + 1)::INT) AS v6 FROM range(1000) t(i)")
def _(spark, sf_dir):
    return fixtures.read(spark, "__mock_agg_input_small")


@frame("table_generator", "SELECT i AS serial, 3 + i % 5 AS cyclic FROM range(1000) t(i)")
def _(spark, sf_dir):
    return spark.range(1000).select(fixtures.serial().alias("serial"), fixtures.cyclic(3, 7).alias("cyclic"))


# Filters and scalar expressions
dialect("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
dialect("filter_eqeq", "SELECT o_orderkey FROM orders WHERE o_orderstatus == 'O'")
dialect("filter_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus != 'P'")
dialect("filter_range", "SELECT l_orderkey, l_linenumber, l_linenumber < 3 AS lt, l_linenumber <= 3 AS le, l_linenumber > 3 AS gt, l_linenumber >= 3 AS ge FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 6")
dialect("filter_and_or", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey > 10 AND c_mktsegment = 'BUILDING'")
dialect("null_logic", "SELECT a, b, a AND b AS both_, a OR b AS either, a = b AS same FROM (VALUES (1 = 1), (1 = 2), (NULL = 1)) AS l(a), (VALUES (1 = 1), (1 = 2), (NULL = 1)) AS r(b)")
dialect("null_arith", "SELECT x, x + 1 AS plus, x - NULL AS minus, x = NULL AS eq FROM (VALUES (1), (NULL)) AS v(x)", "SELECT x, x + 1 AS plus, x - NULL::INT AS minus, x = NULL AS eq FROM (VALUES (1), (NULL)) AS v(x)")
dialect("lower_upper", "SELECT n_nationkey, lower(n_name) AS low, upper(lower(n_name)) AS up FROM nation")
dialect("string_vs_int", "SELECT n_nationkey FROM nation WHERE '9' < n_nationkey", "SELECT n_nationkey FROM nation WHERE '9' < n_nationkey::VARCHAR")


@frame("value_functions", "SELECT n_nationkey, n_nationkey % 7 AS m, n_nationkey // 4 AS d, least(n_nationkey, 9) AS lo, greatest(n_nationkey, 9) AS hi, sqrt(n_nationkey) AS r, n_nationkey = 0 AS zero, n_nationkey::VARCHAR AS s FROM nation")
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    kind = spark.read.parquet(f"{sf_dir}/nation.parquet").schema["n_nationkey"].dataType
    math = lambda o, n: scalars.arithmetic(o, k, F.lit(n), kind, kind)
    return op.project(_t(spark, sf_dir, "nation", "n_nationkey"), k, math("%", 7).alias("m"), math("/", 4).alias("d"), scalars.least(k, F.lit(9)).alias("lo"), scalars.greatest(k, F.lit(9)).alias("hi"), scalars.sqrt(k).alias("r"), scalars.is_zero(k).alias("zero"), scalars.cast_as(k, "varchar", kind).alias("s"))


@frame("strict_string_functions", "SELECT lower(r_name) AS low, upper(r_name) AS up, true AS wrong_type, true AS wrong_count, true AS unknown FROM region")
def _(spark, sf_dir):
    df = _t(spark, sf_dir, "region")
    name, key, kinds = F.col("r_name"), F.col("r_regionkey"), {f.name: f.dataType for f in df.schema}

    def refused(*call) -> bool:
        try:
            strings.call(*call)
        except MillraceError:
            return True
        return False

    text = kinds["r_name"]
    checks = {"wrong_type": refused("upper", [key], [kinds["r_regionkey"]]), "wrong_count": refused("lower", [name, name], [text, text]), "unknown": refused("reverse", [name], [text])}
    return df.select(strings.call("lower", [name], [text]).alias("low"), strings.call("upper", [name], [text]).alias("up"), *[F.lit(v).alias(k) for k, v in checks.items()])


# Joins
dialect("join_inner", "SELECT c.c_custkey, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey")
dialect("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
dialect("join_left_null_key", "SELECT a.x, b.y FROM (VALUES (1), (NULL), (3)) AS a(x) LEFT JOIN (VALUES (1), (NULL)) AS b(y) ON a.x = b.y")
dialect("join_composite", "SELECT s.s_suppkey, c.c_custkey FROM supplier s INNER JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey")
dialect("join_residual", "SELECT c.c_custkey, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderkey > c.c_custkey")
dialect("join_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a INNER JOIN region b ON a.n_nationkey < b.r_regionkey")
dialect("join_left_theta", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a LEFT JOIN region b ON a.n_nationkey < b.r_regionkey")
dialect("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a, region b")
dialect("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
dialect("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
dialect("join_multiway", "SELECT r.r_name, c.c_custkey, o.o_orderkey FROM region r INNER JOIN nation n ON r.r_regionkey = n.n_regionkey INNER JOIN customer c ON n.n_nationkey = c.c_nationkey INNER JOIN orders o ON c.c_custkey = o.o_custkey")
dialect("join_bushy", "SELECT n.n_name, c.c_custkey, o.o_orderkey FROM (region r INNER JOIN nation n ON r.r_regionkey = n.n_regionkey) INNER JOIN (customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey) ON n.n_nationkey = c.c_nationkey")
dialect("join_left_where", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
dialect("join_repeat_left", "SELECT n.n_nationkey, s.s_suppkey, c.c_custkey FROM (nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey) LEFT JOIN customer c ON s.s_suppkey = c.c_custkey")


@frame("join_index", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf_dir):
    o, c = _t(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), _t(spark, sf_dir, "customer", "c_custkey", "c_name")
    return op.index_join(o, c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


# Aggregates
dialect("agg_scalar", "SELECT count(*) AS n, count(o_orderstatus) AS k, min(o_orderkey) AS lo, max(o_orderkey) AS hi, sum(o_custkey) AS s FROM orders", "SELECT count(*) AS n, count(o_orderstatus) AS k, min(o_orderkey) AS lo, max(o_orderkey) AS hi, sum(o_custkey)::BIGINT AS s FROM orders")
dialect("agg_empty_compat", "SELECT count(*) AS n, count(o_orderkey) AS k, sum(o_orderkey) AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE 1 = 2", "SELECT count(*) AS n, CASE WHEN count(o_orderkey) = 0 THEN NULL ELSE count(o_orderkey) END AS k, sum(o_orderkey)::BIGINT AS s, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE 1 = 2")
dialect("agg_empty_group", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE 1 = 2 GROUP BY o_orderstatus")
dialect("agg_group", "SELECT o_orderstatus, count(*) AS n, sum(o_custkey) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus")
dialect("agg_group_multi", "SELECT l_returnflag, l_linestatus, count(l_tax) AS n, max(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("agg_group_expr", "SELECT l_linenumber + 1 AS k, count(*) AS n FROM lineitem GROUP BY l_linenumber + 1")
dialect("agg_expr_over_agg", "SELECT n_regionkey, max(n_nationkey) + min(n_nationkey) AS e, count(*) + n_regionkey AS f FROM nation GROUP BY n_regionkey")
dialect("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 4 AND c_nationkey < 20")
dialect("agg_nested", "SELECT DISTINCT n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) AS t")
dialect("agg_group_null", "SELECT o.o_orderstatus AS k, count(*) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY o.o_orderstatus")
dialect("agg_distinct", "SELECT count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey) AS s FROM orders", "SELECT count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::BIGINT AS s FROM orders")
dialect("distinct_one", "SELECT DISTINCT l_returnflag FROM lineitem")
dialect("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")


# Values that a group's rows share, so that the order of rows does not matter.
dialect("agg_first_last", "SELECT n_regionkey, first(n_regionkey + 1) AS f, last(n_regionkey * 2) AS l, first(lower('Ab')) AS s FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, n_regionkey + 1 AS f, n_regionkey * 2 AS l, 'ab' AS s FROM nation GROUP BY n_regionkey")


@frame("agg_count_standard", "SELECT count(o_orderkey) AS k FROM orders WHERE 1 = 2")
def _(spark, sf_dir):
    return agg.aggregate(_t(spark, sf_dir, "orders").where("1 = 2"), [], [agg.count(F.col("o_orderkey"), compat=False).alias("k")])


# Sort, limit, top-N
dialect("sort_asc_desc", "SELECT c_nationkey, c_custkey FROM customer ORDER BY c_nationkey DESC, c_custkey ASC")
dialect("sort_expr", "SELECT n_nationkey, n_regionkey FROM nation ORDER BY n_regionkey - n_nationkey, n_nationkey")
dialect("sort_index_equiv", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey")
dialect("topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
dialect("topn_expr", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey - l_linenumber, l_orderkey, l_linenumber LIMIT 15")
dialect("topn_nested", "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50) AS t ORDER BY o_custkey, o_orderkey LIMIT 7")
dialect("limit_ordered", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 20")


@frame("topn_plan", "SELECT * FROM (VALUES ('hash_join', 2, 0, 0), ('nlj', 0, 1, 0), ('sort_limit', 0, 0, 1), ('limit_in_subquery', 0, 0, 2)) AS v(query, hash_joins, loops, topns)")
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    texts = {
        "hash_join": "SELECT n_name, c_custkey FROM nation, region, customer WHERE n_regionkey = r_regionkey AND c_nationkey = n_nationkey",
        "nlj": "SELECT n_name FROM nation INNER JOIN region ON n_regionkey < r_regionkey",
        "sort_limit": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3",
        "limit_in_subquery": "SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 50) AS t ORDER BY o_custkey, o_orderkey LIMIT 7",
    }
    rows = [(k, *[plans.count(s.sql(q), x) for x in ("hash_join", "nlj", "topn")]) for k, q in texts.items()]
    return spark.createDataFrame(rows, "query string, hash_joins int, loops int, topns int")


# Subqueries and CTEs
dialect("subquery_from", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) AS t WHERE t.n > 3")
dialect("cte_basic", "WITH t AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT r.r_name, t.n FROM region r INNER JOIN t ON r.r_regionkey = t.k")
dialect("cte_reuse", "WITH t AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.k AS x, b.k AS y FROM t AS a INNER JOIN t AS b ON a.n = b.n")
dialect("trailing_comma", "SELECT n_nationkey, n_name, FROM nation", "SELECT n_nationkey, n_name FROM nation")

# DML and statements
MAKE = "CREATE TABLE t (a int, b int, s varchar(64)); INSERT INTO t SELECT n_nationkey, n_regionkey, n_name FROM nation;"
dialect("dml_insert", MAKE + "INSERT INTO t VALUES (100, NULL, 'x'), (101, 1, NULL); SELECT * FROM t", "SELECT n_nationkey AS a, n_regionkey AS b, n_name AS s FROM nation UNION ALL VALUES (100, NULL, 'x'), (101, 1, NULL)")
dialect("dml_insert_select", MAKE + "INSERT INTO t SELECT a + 1000, b, s FROM t WHERE b = 2; SELECT * FROM t", "SELECT n_nationkey AS a, n_regionkey AS b, n_name AS s FROM nation UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name FROM nation WHERE n_regionkey = 2")
dialect("dml_update", MAKE + "UPDATE t SET b = a + b, a = b WHERE b >= 3; SELECT * FROM t", "SELECT CASE WHEN n_regionkey >= 3 THEN n_regionkey ELSE n_nationkey END AS a, CASE WHEN n_regionkey >= 3 THEN n_nationkey + n_regionkey ELSE n_regionkey END AS b, n_name AS s FROM nation")
dialect("dml_delete", MAKE + "DELETE FROM t WHERE b = 1 OR a > 20; SELECT * FROM t", "SELECT n_nationkey AS a, n_regionkey AS b, n_name AS s FROM nation WHERE NOT (n_regionkey = 1 OR n_nationkey > 20)")


@frame("dml_counts", "SELECT 1 AS step, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 2, (SELECT count(*) FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 3, (SELECT count(*) FROM nation WHERE n_regionkey <> 2) UNION ALL SELECT 4, (SELECT count(*) FROM nation WHERE n_regionkey = 2)")
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    texts = ["CREATE TABLE t (a int, b int); INSERT INTO t SELECT n_nationkey, n_regionkey FROM nation", "UPDATE t SET a = 0 WHERE b = 2", "DELETE FROM t WHERE b <> 2", "DELETE FROM t"]
    return spark.createDataFrame([(i + 1, int(s.execute(x)[-1].rows()[0][0])) for i, x in enumerate(texts)], "step int, n bigint")


@frame("session_statements", "SELECT * FROM (VALUES (1, 'Table created with id = 0'), (2, 'Index created with id = 0'), (3, 'x=yes'), (4, 'y=')) AS v(step, said)")
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    said = [s.execute(x)[-1].message for x in ("CREATE TABLE t (a int, b varchar(8))", "CREATE INDEX i ON t (a)", "SET x = yes; SHOW x", "SHOW y")]
    return spark.createDataFrame(list(enumerate(said, 1)), "step int, said string")


@frame("meta_commands", "SELECT * FROM (VALUES ('t', 'a:int, b:varchar(8)'), ('region', 'r_regionkey:int, r_name:string'), ('__mock_t8', 'v4:int'), ('empty_table', 'colA:int'), ('i', 'a')) AS v(name, cols)")
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE TABLE t (a int, b varchar(8)); CREATE INDEX i ON t (a)")
    tables = s.sql(r"\dt").where(F.col("name").isin("t", "region", "__mock_t8", "empty_table")).selectExpr("name", "cols")
    return tables.union(s.sql(r"\di").selectExpr("index_name", "index_cols"))


@frame(
    "explain_modes",
    """SELECT * FROM (VALUES
    ('select', 'PLANNER', 'Project Project Filter Project Relation'), ('select', 'OPTIMIZER', 'Project Filter Relation'), ('select', 'SCHEMA', '(name:string, more:int)'),
    ('insert', 'PLANNER', 'Insert Project Project Filter Project Relation'), ('delete', 'SCHEMA', '(__mill.rows:int)'), ('update', 'OPTIMIZER', 'Update Project Filter Relation')) AS v(statement, mode, shown)""",
)
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE TABLE t (s varchar(64), k int); INSERT INTO t VALUES ('x', 1), ('y', 2)")
    texts = {"select": "SELECT n_name AS name, n_nationkey + 1 AS more FROM nation WHERE n_regionkey = 2", "insert": "INSERT INTO t SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 2", "delete": "DELETE FROM t WHERE k = 1", "update": "UPDATE t SET k = k + 1 WHERE k = 2"}
    rows = []
    for kind, mode in (("select", "PLANNER"), ("select", "OPTIMIZER"), ("select", "SCHEMA"), ("insert", "PLANNER"), ("delete", "SCHEMA"), ("update", "OPTIMIZER")):
        said = s.execute(f"EXPLAIN ({mode.lower()}) {texts[kind]}")[0].message
        rows.append((kind, mode, said.split("\n", 1)[1] if mode == "SCHEMA" else " ".join(plans.operators(said, mode))))
    return spark.createDataFrame(rows, "statement string, mode string, shown string")


# Iteration and the three million-row shapes
GRAPH = "SELECT l.src AS src, r.dst AS dst, l.distance + r.distance AS distance FROM {} AS l INNER JOIN __mock_graph AS r ON l.dst = r.src"
HOP = "SELECT src, dst, min(distance) AS distance FROM ({}) AS p GROUP BY src, dst"
EDGES = "(SELECT i % 10 AS src, i // 10 AS dst, CASE WHEN i % 10 <> i // 10 THEN 1 END AS distance FROM range(100) g(i))"
dialect("graph_k_hop", HOP.format(GRAPH.format("(" + HOP.format(GRAPH.format("__mock_graph")) + ")")), HOP.format(GRAPH.format("(" + HOP.format(GRAPH.format(EDGES)) + ")")).replace("__mock_graph", EDGES))


@frame(
    "graph_shortest_path",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst, n_regionkey + 1 AS d FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 3 FROM nation),
    p(src, dst, d, hops) AS (SELECT src, dst, d, 1 FROM e UNION ALL SELECT p.src, e.dst, p.d + e.d, hops + 1 FROM p JOIN e ON p.dst = e.src WHERE hops < 5)
    SELECT src, dst, min(d)::INT AS d FROM p GROUP BY src, dst""",
)
def _(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE TABLE e (src int, dst int, d int); INSERT INTO e SELECT n_nationkey, (n_nationkey * 2 + 1) % 25, n_regionkey + 1 FROM nation; INSERT INTO e SELECT n_nationkey, (n_nationkey + 7) % 25, 3 FROM nation")
    s.execute("CREATE TABLE best (src int, dst int, d int); CREATE TABLE tmp (src int, dst int, d int); INSERT INTO best SELECT src, dst, min(d) FROM e GROUP BY src, dst")
    for _ in range(4):
        s.execute("DELETE FROM tmp; INSERT INTO tmp SELECT * FROM best; INSERT INTO tmp SELECT b.src, e.dst, b.d + e.d FROM best b INNER JOIN e ON b.dst = e.src")
        s.execute("DELETE FROM best; INSERT INTO best SELECT src, dst, min(d) FROM tmp GROUP BY src, dst")
    return s.sql("SELECT src, dst, d FROM best")


dialect("leaderboard_q1", "SELECT x, y, z FROM __mock_t1 WHERE x >= 90 AND y = 10", "SELECT i // 10000 AS x, i % 10000 AS y, i AS z FROM range(1000000) t(i) WHERE i // 10000 >= 90 AND i % 10000 = 10")
dialect(
    "leaderboard_q2",
    "SELECT count(*) AS n, max(a.x) AS ax, max(a.y) AS ay, max(b.x) AS bx, max(b.y) AS byy, max(c.x) AS cx, max(c.y) AS cy FROM __mock_t4_1m a, __mock_t5_1m b, __mock_t6_1m c WHERE (a.x = b.x) AND (c.y = b.y) AND (a.y >= 1000000) AND (a.y < 1500000) AND (c.x < 150000) AND (c.x >= 100000)",
    "WITH k AS (SELECT i % 500000 AS x, i % 500000 * 10 AS y FROM range(1000000) t(i)) SELECT count(*) AS n, max(a.x) AS ax, max(a.y) AS ay, max(b.x) AS bx, max(b.y) AS byy, max(c.x) AS cx, max(c.y) AS cy FROM k a, k b, k c WHERE a.x = b.x AND c.y = b.y AND a.y >= 1000000 AND a.y < 1500000 AND c.x < 150000 AND c.x >= 100000",
)
dialect(
    "leaderboard_q3",
    "SELECT v, d1, d2 FROM (SELECT v, max(v1) AS d1, max(v1) + max(v1) + max(v2) AS d2, min(v1), max(v2), min(v2) FROM __mock_t7 LEFT JOIN (SELECT v4 FROM __mock_t8 WHERE 1 == 2) ON v < v4 GROUP BY v)",
    "SELECT i % 20 AS v, max(i) AS d1, 3 * max(i) AS d2 FROM range(1000000) t(i) GROUP BY 1",
)

# Beyond the reference's own operators, where Spark has them anyway.
for _how, _sql in {"right": "RIGHT JOIN", "full": "FULL JOIN"}.items():
    dialect(f"join_{_how}", f"SELECT s.s_suppkey, c.c_custkey FROM supplier s {_sql} customer c ON s.s_suppkey = c.c_custkey")


@frame("join_semi_anti", "SELECT c_custkey, true AS has FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "c_custkey"), _t(spark, sf_dir, "orders", "o_custkey")
    on = c.c_custkey == o.o_custkey
    return op.join(c, o, on, "left_semi").withColumn("has", F.lit(True)).union(op.join(c, o, on, "left_anti").withColumn("has", F.lit(False)))

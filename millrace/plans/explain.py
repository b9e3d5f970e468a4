"""Plans as text, and predicates over physical plans for tests."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

MODES = {"b": "binder", "p": "planner", "o": "optimizer", "s": "schema"}
#: What must stand in a physical plan for a strategy to have been taken.
STRATEGIES = {
    "topn": r"TakeOrderedAndProject",
    "hash_join": r"BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin",
    "index_join": r"BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin",
    "nlj": r"BroadcastNestedLoopJoin|CartesianProduct",
    "index_scan": r"Sort|TakeOrderedAndProject",
}


def physical(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(df: DataFrame, strategy: str) -> int:
    return len(re.findall(STRATEGIES[strategy], physical(df)))


def explain(df: DataFrame, statement: tuple, modes: list[str] | None = None, target: str | None = None) -> str:
    """target: what is done with the rows of df, such as `Insert t`; it stands above the plans of a changing statement."""
    wanted = {MODES.get(m, m) for m in modes or MODES.values()}
    execution = df._jdf.queryExecution()
    head = f"{target}\n" if target else ""
    parts = []
    if "binder" in wanted:
        parts.append(f"=== BINDER ===\n{statement}")
    if "planner" in wanted:
        parts.append(f"=== PLANNER ===\n{head}{execution.analyzed().toString()}")
    if "optimizer" in wanted:
        parts.append(f"=== OPTIMIZER ===\n{head}{execution.optimizedPlan().toString()}\n{head}{execution.executedPlan().toString()}")
    if "schema" in wanted:
        own = "__mill.rows:int" if target else ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
        parts.append(f"=== SCHEMA ===\n({own})")
    return "\n".join(parts)


def operators(text: str, section: str) -> list[str]:
    """The operators of a section of explain(), from the root down, without what Spark numbers or sizes."""
    body = text.split(f"=== {section} ===\n", 1)[1].split("\n===", 1)[0]
    names = [re.match(r"[\s:+\-*()0-9]*([A-Za-z]+)", line) for line in body.split("\n\n")[0].splitlines()]
    return [m[1] for m in names if m]

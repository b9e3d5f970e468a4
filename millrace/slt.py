"""Runs golden files: `statement ok|error`, `query [rowsort] [+ensure:plan[*n]] [+timing:xN[:label]]`, `----`, `include`, `halt`, `sleep`."""

from __future__ import annotations

import re
import time
from pathlib import Path

from millrace.plans import explain
from millrace.session import EngineSession


def records(path: Path) -> list[tuple[int, list[str], str, list[str]]]:
    """Line number, head words, SQL and expected lines of each record."""
    out = []
    lines = [*path.read_text().splitlines(), ""]
    i = 0
    while i < len(lines):
        head = lines[i].split()
        at = i + 1
        i += 1
        if not head or head[0].startswith("#"):
            continue
        if head[0] == "include":
            out += records(path.parent / head[1])
            continue
        if head[0] in ("halt", "sleep"):
            out.append((at, head, "", []))
            continue
        sql, expected = [], []
        while i < len(lines) and lines[i].strip() not in ("", "----"):
            sql.append(lines[i])
            i += 1
        if i < len(lines) and lines[i].strip() == "----":
            i += 1
            while i < len(lines) and lines[i].strip():
                expected.append(lines[i].rstrip())
                i += 1
        out.append((at, head, "\n".join(sql), expected))
    return out


def run(session: EngineSession, path: Path) -> list[str]:
    """What differs from the golden file; timings are printed."""
    wrong = []
    for at, head, sql, expected in records(path):
        if head[0] == "halt":
            break
        if head[0] == "sleep":
            time.sleep(float(head[1].removesuffix("s")))
            continue
        try:
            results = session.execute(sql)
            lines = [" ".join(row).rstrip() for r in results for row in r.rows()]
        except Exception as e:
            if head[:2] != ["statement", "error"]:
                wrong.append(f"{path.name}:{at}: {e}")
            continue
        if head[0] == "statement":
            if head[1] == "error":
                wrong.append(f"{path.name}:{at}: no error")
            continue
        expected = [x.strip() for x in expected]
        if "rowsort" in head or not results[-1].ordered:
            lines, expected = sorted(lines), sorted(expected)
        if lines != expected:
            wrong.append(f"{path.name}:{at}: expected {expected}, got {lines}")
        for word in head:
            if m := re.match(r"\+ensure:(\w+?)(?:\*(\d+))?$", word):
                if m[1] in explain.STRATEGIES and explain.count(results[-1].df, m[1]) < int(m[2] or 1):
                    wrong.append(f"{path.name}:{at}: no {word} in the plan")
            if m := re.match(r"\+timing:x(\d+)(?::(.*))?$", word):
                took = []
                for _ in range(int(m[1])):
                    began = time.time()
                    [r.rows() for r in session.execute(sql)]
                    took.append(round((time.time() - began) * 1000))
                print(f"{path.name} {m[2] or at}: {took} ms")
    return wrong

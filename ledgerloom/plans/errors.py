"""Hints for queries that don't bind."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

RESERVED = frozenset("from to order group table user select where join on using".split())


def distance(a: str, b: str) -> int:
    """Edits between two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(name: str, names) -> str | None:
    """The nearest of the names, if it is near enough to be meant."""
    best = min(sorted(names), key=lambda n: distance(name.lower(), n.lower()), default=None)
    return best if best is not None and distance(name.lower(), best.lower()) <= max(2, len(name) // 3) else None


def hint(error, tables: dict[str, DataFrame], unknown_table: str | None = None, declared: dict[str, str] | None = None) -> str:
    """The message, led by what may be meant."""
    raw = str(error)
    columns = sorted({c for df in tables.values() for c in df.columns})
    if unknown_table is not None:
        if declared and unknown_table in declared:
            return f"{unknown_table} is declared (event {declared[unknown_table]}) but has no rows yet"
        near = closest(unknown_table, tables)
        return f"there is no table {unknown_table}" + (f"; the nearest is {near}" if near else "")
    condition = error.getCondition() if isinstance(error, PySparkException) else ""
    if condition and condition.startswith("UNRESOLVED_COLUMN"):
        m = re.search(r"name `([^`]+)`(?:\.`([^`]+)`)?", raw)
        name = (m[2] or m[1]) if m else ""
        if f"{name}_dec" in columns:
            return f"there is no column {name} here, but {name}_dec, its exact number. {raw}"
        if name.endswith("_dec") and name[:-4] in columns:
            return f"{name[:-4]} has no exact companion: it isn't a big number. {raw}"
        near = closest(name, columns)
        return (f"there is no column {name}" + (f"; the nearest is {near}" if near else "") + ". ") + raw
    if condition == "PARSE_SYNTAX_ERROR":
        word = re.search(r"at or near '?\"?(\w+)", raw)
        if word and word[1].lower() in RESERVED:
            return f"{word[1].lower()} is a reserved word: write \"{word[1].lower()}\" for the column. {raw}"
    if condition and condition.startswith("DATATYPE_MISMATCH") and re.search(r"(?i)boolean", raw):
        return f"bools are stored as the words 'true' and 'false': compare with = 'true'. {raw}"
    return raw


def text_sum_of_big(df: DataFrame) -> str | None:
    """A complaint where text is added up: the engine would take it for floating point."""
    plan = df._jdf.queryExecution().analyzed().toString()
    m = re.search(r"\b(sum|avg)\(cast\((\w+)#\d+ as double\)\)", plan)
    if not m:
        return None
    return f"{m[1]}({m[2]}) would add text as floating point; use {m[2]}_dec, the exact number, or cast it"

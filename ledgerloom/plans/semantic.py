"""Descriptions of tables for people and programs: what is known, what to beware of, what has drifted."""

from __future__ import annotations

from ledgerloom.functions.columns import BIG_KINDS


def footguns(table: str, columns: dict[str, str]) -> list[str]:
    """What goes wrong easily with a table's columns."""
    out = []
    for c, kind in sorted(columns.items()):
        if kind in BIG_KINDS:
            out.append(f"{table}.{c} is exact text; add up {c}_dec, and look at {c}_overflow for what that can't hold")
        elif kind == "bool":
            out.append(f"{table}.{c} is the word 'true' or 'false'")
        elif kind == "hash32":
            out.append(f"{table}.{c} is the hash of a value that isn't stored")
        elif kind == "json":
            out.append(f"{table}.{c} is JSON text with numbers as text")
        if c.lower() in ("from", "to", "order", "group", "table", "user"):
            out.append(f'{table}."{c}" needs quotes')
    return out


def describe(schema: dict[str, dict[str, str]], written: dict[str, dict]) -> tuple[dict[str, dict], list[str]]:
    """(table -> description, columns, footguns; warnings). ``written`` holds what people said about tables and columns;
    what it says about things that aren't there (any more) is a warning."""
    out, warnings = {}, []
    for table, columns in sorted(schema.items()):
        said = written.get(table, {})
        texts = said.get("columns", {})
        warnings += [f"{table}.{c} is described but isn't there" for c in sorted(set(texts) - set(columns))]
        out[table] = {"description": said.get("description", ""), "columns": {c: {"kind": k, "description": texts.get(c, "")} for c, k in sorted(columns.items())}, "footguns": footguns(table, columns)}
    warnings += [f"{t} is described but isn't there" for t in sorted(set(written) - set(schema))]
    return out, warnings


def merge(old: dict[str, dict], new: dict[str, dict]) -> dict[str, dict]:
    """Descriptions of both; the new ones count where they say something."""
    out = {}
    for t in sorted({*old, *new}):
        a, b = old.get(t, {}), new.get(t, {})
        out[t] = {"description": b.get("description") or a.get("description", ""), "columns": {**a.get("columns", {}), **{c: d for c, d in b.get("columns", {}).items() if d}}}
    return out

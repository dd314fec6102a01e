"""Named queries with typed parameters, and which queries callers may send."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

_NAME, _PARAM = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9_]+")
_MARK = re.compile(r":([A-Za-z_][A-Za-z0-9_]*)")


def as_int(text: str) -> int:
    if not re.fullmatch(r"-?\d{1,18}", str(text)):
        raise ValueError(f"not a whole number: {text!r}")
    return int(text)


def as_address(text: str) -> str:
    if not re.fullmatch(r"0[xX][0-9a-fA-F]{40}", str(text)):
        raise ValueError(f"not an address: {text!r}")
    return str(text).lower()


TYPES = {"int": as_int, "address": as_address}


@dataclass(frozen=True)
class NamedQuery:
    """``sql`` holds ``:name`` markers; values are bound, never pasted into the text."""

    name: str
    sql: str
    params: dict[str, str] = field(default_factory=dict)

    def validate(self) -> None:
        """Names, types and markers must fit: an unknown marker or an unused parameter is a mistake."""
        if not _NAME.fullmatch(self.name):
            raise ValueError(f"not a query name: {self.name!r}")
        for p, kind in self.params.items():
            if not _PARAM.fullmatch(p) or kind not in TYPES:
                raise ValueError(f"{self.name}: parameter {p!r} of type {kind!r} isn't valid")
        used = set(_MARK.findall(re.sub(r"'(?:[^'\\]|\\.)*'", "''", self.sql)))
        if used != set(self.params):
            raise ValueError(f"{self.name}: declared {sorted(self.params)}, used {sorted(used)}")

    def bind(self, given: dict[str, str]) -> dict:
        """Checked values; all parameters and no others must be given."""
        if set(given) != set(self.params):
            raise ValueError(f"{self.name} takes {sorted(self.params)}, not {sorted(given)}")
        return {p: TYPES[kind](given[p]) for p, kind in self.params.items()}


class Queries:
    """``open`` takes any query that the guard takes, ``allowlist`` only named ones, ``deny`` none."""

    def __init__(self, surface, mode: str = "open", queries: list[NamedQuery] = ()):
        if mode not in ("open", "allowlist", "deny"):
            raise ValueError(f"unknown mode {mode!r}")
        if mode == "open" and queries:
            raise ValueError("named queries have no effect while any query is open")
        if mode == "allowlist" and not queries:
            raise ValueError("an allowlist without queries allows nothing")
        for q in queries:
            q.validate()
        self.surface, self.mode, self.queries = surface, mode, {q.name: q for q in queries}
        if len(self.queries) != len(queries):
            raise ValueError("a query name is there twice")

    def listing(self) -> list[dict]:
        return [{"name": q.name, "params": dict(q.params)} for _, q in sorted(self.queries.items())]

    def free(self, sql: str) -> DataFrame:
        from ledgerloom.plans.guard import Refused

        if self.mode != "open":
            raise Refused("only named queries are allowed")
        return self.surface.frame(sql)

    def named(self, name: str, given: dict[str, str]) -> DataFrame:
        from ledgerloom.plans.guard import Refused

        if self.mode == "deny" or name not in self.queries:
            raise Refused(f"there is no query {name}")
        q = self.queries[name]
        return self.surface.frame(q.sql, q.bind(given) or None)

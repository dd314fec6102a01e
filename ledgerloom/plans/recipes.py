"""Ready-made views over a contract's tables, as SQL for authored view files."""

from __future__ import annotations

import re

from ledgerloom.functions.columns import ZERO_ADDRESS

_EXACT = "try_cast({} AS DECIMAL(38,0))"


def _moves(alias: str) -> str:
    value = _EXACT.format("value")
    return f'SELECT inline(array(struct(lower("to") AS addr, {value} AS delta), struct(lower("from") AS addr, -{value} AS delta))) FROM {alias}__transfer'


def _balances(alias: str) -> str:
    return f"SELECT addr, sum(delta) AS balance FROM ({_moves(alias)}) WHERE addr <> '{ZERO_ADDRESS}' GROUP BY addr HAVING sum(delta) <> 0"


def _supply(alias: str) -> str:
    side = lambda c: f"coalesce(sum({_EXACT.format('value')}) FILTER (WHERE lower(\"{c}\") = '{ZERO_ADDRESS}'), 0)"
    return f"SELECT {side('from')} - {side('to')} AS total_supply FROM {alias}__transfer"


def _reserves(alias: str) -> str:
    last = lambda c: f"try_cast(max_by({c}, struct(block_number, log_index)) AS DECIMAL(38,0)) AS {c}"
    return f"SELECT address, {last('reserve0')}, {last('reserve1')} FROM {alias}__sync GROUP BY address"


RECIPES = {"balances": _balances, "holder_count": lambda a: f"SELECT count(*) AS holders FROM ({_balances(a)})", "total_supply": _supply, "reserves": _reserves}


def view_sql(name: str, alias: str) -> str:
    """CREATE VIEW for a recipe over the contract ``alias``."""
    if name not in RECIPES:
        raise ValueError(f"unknown recipe {name!r}; there are {', '.join(sorted(RECIPES))}")
    if not re.fullmatch(r"[A-Za-z0-9_]+", alias):
        raise ValueError(f"not an alias: {alias!r}")
    return f"CREATE VIEW {alias}_{name} AS {RECIPES[name](alias)};"

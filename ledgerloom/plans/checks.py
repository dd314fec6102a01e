"""Recorded answers: queries whose rows must stay as they were, order included."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame


def plain(v):
    """A value as JSON has it: exact numbers as text."""
    if isinstance(v, Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return "0x" + bytes(v).hex()
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def record(df: DataFrame) -> str:
    return json.dumps({"columns": df.columns, "rows": [[plain(v) for v in r] for r in df.collect()]})


def run_checks(surface, checks: dict[str, str], recorded: dict[str, str]) -> dict[str, str]:
    """name -> "same", "new" or what differs."""
    out = {}
    for name, sql in sorted(checks.items()):
        now = json.loads(record(surface.frame(sql)))
        if name not in recorded:
            out[name] = "new"
            continue
        then = json.loads(recorded[name])
        if then == now:
            out[name] = "same"
        elif then["columns"] != now["columns"]:
            out[name] = f"columns {then['columns']} became {now['columns']}"
        else:
            k = next((i for i, (a, b) in enumerate(zip(then["rows"], now["rows"])) if a != b), min(len(then["rows"]), len(now["rows"])))
            out[name] = f"row {k} differs"
    return out

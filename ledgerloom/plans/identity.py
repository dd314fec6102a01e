"""What makes two derivations the same: reuse keys, view graphs, determinism, dataset identity, schema changes."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.guard import parse

ENGINE = "ledgerloom-1"
#: Functions whose results change from run to run, or with their surroundings.
VOLATILE = frozenset(
    """rand random randn randstr uniform uuid shuffle now current_timestamp current_date curdate current_time localtimestamp
    unix_timestamp monotonically_increasing_id spark_partition_id input_file_name current_user user session_user
    current_catalog current_database current_schema current_timezone version first last any_value first_value last_value
    approx_count_distinct approx_percentile percentile_approx collect_list collect_set""".split()
)


def _number_ids(text: str) -> str:
    seen: dict[str, str] = {}
    return re.sub(r"#(\d+)L?", lambda m: seen.setdefault(m[1], f"#{len(seen)}"), text)


def reuse_key(df: DataFrame, sources: dict[str, str], block_range: tuple[int, int] | None = None) -> str:
    """A key of a derivation: white space, comments and table aliases don't matter; literals, names and order
    of output columns, DISTINCT and the order of conditions do. ``sources`` says what the tables held."""
    plan = df._jdf.queryExecution().analyzed().toString()
    plan = re.sub(r"SubqueryAlias [^\n]*\n", "SubqueryAlias\n", plan)
    shape = _number_ids(plan)
    columns = [[f.name, f.dataType.simpleString()] for f in df.schema]
    return hashlib.sha256(json.dumps([ENGINE, shape, columns, sorted(sources.items()), block_range]).encode()).hexdigest()


def refusals(spark: SparkSession, sql: str) -> list[str]:
    """Why a query's result must never be used again; empty if it may."""
    parsed, out = parse(spark, sql), []
    out += [f"{f} is volatile" for f in sorted(parsed.functions & VOLATILE)]
    tree = parsed.plan.toString()
    if re.search(r"\b(GlobalLimit|LocalLimit|Limit)\b", tree) and not re.search(r"(GlobalLimit|LocalLimit|'?Limit)[^\n]*\n(?:[ :+-]*(GlobalLimit|LocalLimit)[^\n]*\n)*[ :+-]*'?Sort\b", tree):
        out.append("LIMIT without ORDER BY")
    return out


def ordered_digest(df: DataFrame) -> str:
    """A hash of the rows in the order in which they come. Chunks are hashed where they are; only digests travel."""
    h = hashlib.sha256()
    for row in df.select(F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("d")).toLocalIterator():
        h.update(row["d"].encode())
    return h.hexdigest()


def is_deterministic(make) -> bool:
    """Whether two runs give the same rows in the same order."""
    return ordered_digest(make()) == ordered_digest(make())


def view_graph(spark: SparkSession, bodies: dict[str, str]) -> dict[str, set[str]]:
    """view -> relations it reads."""
    return {v: parse(spark, sql).relations for v, sql in bodies.items()}


def build_order(graph: dict[str, set[str]]) -> list[str]:
    """Views after what they read; ValueError for a cycle, naming it."""
    order, state = [], {}

    def visit(v: str, path: tuple[str, ...]) -> None:
        if state.get(v) == 2:
            return
        if v in path:
            raise ValueError("views read each other: " + " -> ".join([*path[path.index(v) :], v]))
        for w in sorted(graph.get(v, ())):
            if w in graph:
                visit(w, (*path, v))
        state[v] = 2
        order.append(v)

    for v in sorted(graph):
        visit(v, ())
    return order


def merkle_keys(graph: dict[str, set[str]], own: dict[str, str], sources: dict[str, str]) -> dict[str, str]:
    """Keys of views that change with anything they are made of."""
    keys: dict[str, str] = {}
    for v in build_order(graph):
        inputs = sorted((w, keys.get(w) or sources.get(w, "")) for w in graph[v])
        keys[v] = hashlib.sha256(json.dumps([own[v], inputs]).encode()).hexdigest()
    return keys


def dataset_identity(parts: dict[str, str]) -> str:
    """A hash of the inputs that decide a dataset's rows. Names starting with ``_`` are cosmetic and don't count."""
    return hashlib.sha256(json.dumps(sorted((k, v) for k, v in parts.items() if not k.startswith("_"))).encode()).hexdigest()


def classify_schema_change(old: dict[str, dict[str, str]], new: dict[str, dict[str, str]]) -> tuple[str, list[str]]:
    """("breaking" or "compatible", changes): what was there must stay as it was, anything may be added."""
    gone = [f"table {t} removed" for t in sorted(set(old) - set(new))]
    added = [f"table {t} added" for t in sorted(set(new) - set(old))]
    for t in sorted(set(old) & set(new)):
        gone += [f"column {t}.{c} removed" for c in sorted(set(old[t]) - set(new[t]))]
        gone += [f"column {t}.{c} retyped from {old[t][c]} to {new[t][c]}" for c in sorted(set(old[t]) & set(new[t])) if old[t][c] != new[t][c]]
        added += [f"column {t}.{c} added" for c in sorted(set(new[t]) - set(old[t]))]
    return ("breaking" if gone else "compatible"), gone + added


def policy_guard(indexed: dict[str, str], current: dict[str, str]) -> None:
    """Refuse to go on where what was indexed was decided otherwise."""
    if changed := sorted(k for k in indexed if k in current and indexed[k] != current[k]):
        raise ValueError(f"the rows that are there were made with another {', '.join(changed)}")

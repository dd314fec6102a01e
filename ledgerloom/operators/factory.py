"""Contracts that other contracts create: discovery, the registry of children, and decoding in two phases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 3


@dataclass(frozen=True)
class Rule:
    """Children of ``template`` are what the parameter ``child`` of ``table`` rows names, from block ``start`` on."""

    watch: str  # alias of a contract or template
    table: str
    child: str
    template: str
    start: int = 0


def validate(rules: list[Rule], contracts: set[str], templates: set[str]) -> list[list[Rule]]:
    """The rules by depth; ValueError for names that clash or aren't there, repeated rules and chains that are too long."""
    if clash := contracts & templates:
        raise ValueError(f"both contract and template: {', '.join(sorted(clash))}")
    seen = set()
    for r in rules:
        if r.watch not in contracts | templates:
            raise ValueError(f"nothing is called {r.watch}")
        if r.template not in templates:
            raise ValueError(f"no template {r.template}")
        if (key := (r.table, r.child, r.template)) in seen:
            raise ValueError(f"a rule is there twice: {key}")
        seen.add(key)
    levels, known = [], set(contracts)
    left = list(rules)
    while left:
        level = [r for r in left if r.watch in known]
        if not level:
            raise ValueError("rules watch templates that no rule creates")
        levels.append(level)
        if len(levels) > DEEPEST:
            raise ValueError(f"templates are nested deeper than {DEEPEST}")
        known |= {r.template for r in level}
        left = [r for r in left if r not in level]
    return levels


def discoveries(rows: DataFrame, rule: Rule) -> DataFrame:
    """(address, template, discovered_block, discovered_log_index, parent_address) that a rule finds. Values that aren't addresses don't fire."""
    child = F.lower(F.col(f"`{rule.child}`"))
    fires = child.rlike("^0x[0-9a-f]{40}$") & (F.col("block_number") >= rule.start)
    return rows.where(fires).select(child.alias("address"), F.lit(rule.template).alias("template"), F.col("block_number").alias("discovered_block"), F.col("log_index").alias("discovered_log_index"), F.lower("address").alias("parent_address"))


def first_wins(found: DataFrame) -> DataFrame:
    """One row for each child: its first discovery, whichever template that was under."""
    one = found.groupBy("address").agg(F.min(F.struct("discovered_block", "discovered_log_index", "template", "parent_address")).alias("f"))
    return one.select("address", "f.template", "f.discovered_block", "f.discovered_log_index", "f.parent_address")


def rollback(children: DataFrame, block: int) -> DataFrame:
    """Children known at a block."""
    return children.where(F.col("discovered_block") <= block)


def content_hash(children: DataFrame) -> str:
    """A hash of the set of children that doesn't depend on the order of rows."""
    line = F.concat_ws("|", "address", "template", F.col("discovered_block").cast("string"), F.col("discovered_log_index").cast("string"), "parent_address")
    halves = [F.conv(F.substring(F.sha2(line.cast("binary"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    row = children.agg(F.count("*").alias("n"), *(F.sum(h).alias(f"h{k}") for k, h in enumerate(halves))).first()
    import hashlib

    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def decode_window(registry, logs: DataFrame, rules: list[Rule], templates: set[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(table -> rows, children): contracts first, then level by level the children found so far.

    A child's logs count from its discovery on, also within the same block.
    """
    from ledgerloom.operators.decode import decode_children, decode_events

    contracts = {d.alias for d in registry.decoders if d.address}
    tables, children = decode_events(registry, logs), None
    for level in validate(rules, contracts, templates):
        found = [discoveries(tables[r.table], r) for r in level if r.table in tables]
        for f in found:
            children = f if children is None else children.select(f.columns).unionByName(f)
        children = first_wins(children)
        for template in sorted({r.template for r in level}):
            tables |= decode_children(registry, logs, children, template)
    return tables, children

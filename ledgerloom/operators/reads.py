"""Browsing: newest rows, points, ranges, and results with caps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import entity_id, parse_entity_id

MOST_ROWS = 1000


def hot_over_cold(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of both by (block_number, log_index); where both have one, the hot one counts."""
    both = hot.withColumn("_source", F.lit(0)).unionByName(cold.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("block_number", "log_index").orderBy("_source")
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_source")


def recent_rows(cold: DataFrame, hot: DataFrame, limit: int, from_block: int | None = None, to_block: int | None = None) -> DataFrame:
    """The newest rows of a table. Each side gives its newest before the two meet, so little is moved."""
    limit = min(limit, MOST_ROWS)
    order = [F.col("block_number").desc(), F.col("log_index").desc()]

    def newest(df: DataFrame) -> DataFrame:
        if from_block is not None:
            df = df.where(F.col("block_number") >= from_block)
        if to_block is not None:
            df = df.where(F.col("block_number") <= to_block)
        return df.orderBy(*order).limit(limit)

    return hot_over_cold(newest(cold), newest(hot)).orderBy(*order).limit(limit)


def recent_entities(tables: dict[str, DataFrame], limit: int) -> DataFrame:
    """(table, id, row as JSON) of the newest rows over all tables."""
    parts = []
    for name, df in sorted(tables.items()):
        newest = df.orderBy(F.col("block_number").desc(), F.col("log_index").desc()).limit(limit)
        parts.append(newest.select(F.lit(name).alias("table"), entity_id(F.col("block_number"), F.col("log_index")).alias("id"), F.to_json(F.struct(*newest.columns)).alias("row")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("id").desc(), "table").limit(limit)


def entity(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The rows of an entity id; the filters reach the scans."""
    block, index = parse_entity_id(text)
    parts = [df.where((F.col("block_number") == block) & (F.col("log_index") == index)).select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def block_range(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of a block range in chain order, with lower-cased addresses."""
    lowered = {c: F.lower(c) for c in ("from", "to", "address") if c in df.columns}
    return df.where(F.col("block_number").between(first, last)).withColumns(lowered).orderBy("block_number", "log_index")


@dataclass
class Capped:
    """Rows up to the caps, and whether there were more."""

    rows: list = field(default_factory=list)
    truncated: bool = False


def capped(df: DataFrame, most_rows: int = 50_000, most_bytes: int = 64 << 20) -> Capped:
    """Rows for a caller: one beyond the cap is asked for, to know whether there are more.

    All rows of a limit come from one job, so that nothing goes on running once this returns or is interrupted.
    """
    out, size = Capped(), 0
    for row in df.limit(most_rows + 1).collect():
        size += sum(len(str(v)) for v in row)
        if len(out.rows) >= most_rows or size > most_bytes:
            out.truncated = True
            break
        out.rows.append(row)
    return out

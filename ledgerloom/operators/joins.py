"""Logical joins of ledger queries. The engine picks the physical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About so many points and ranges meet in a tile of an interval join, and so many tiles are one task's.
TILE, TASK_TILES = 4096, 16


def using(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join of two event tables by block or transaction; columns that clash are the left's."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.drop(*clash), list(keys))


def within(ledger: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """Ledger rows of the accounts in a set."""
    return ledger.join(accounts.select(key).distinct(), key, "left_semi")


def pending(rows: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Rows with what was resolved for them, or nulls."""
    return rows.join(resolved, key, "left")


def beside(left: DataFrame, single: DataFrame) -> DataFrame:
    """Each left row with the row of a one-row table, or nulls where it has none."""
    one = single.limit(2)
    return left.join(F.broadcast(one), F.lit(True), "left")


def after_discovery(logs: DataFrame, children: DataFrame) -> DataFrame:
    """Logs of discovered children, from their discovery on (that position itself isn't theirs)."""
    kids = children.select(F.col("address").alias("_child"), "discovered_block", "discovered_log_index", "template")
    later = F.struct(F.col("block_number"), F.col("log_index")) > F.struct(F.col("discovered_block"), F.col("discovered_log_index"))
    return logs.join(kids, (F.lower("address") == F.col("_child")) & later).drop("_child", "discovered_block", "discovered_log_index")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str]) -> DataFrame:
    """Each left row with the last right row of its keys whose ``at`` isn't later.

    The two are put into one order, and the last value is carried along: one shuffle by the
    keys and one sort, whatever the number of pairs. ``at`` must be of one type on both sides.
    """
    from pyspark.sql import Window

    carry = F.struct(*value)
    kind = right.select(carry.alias("c")).schema["c"].dataType
    l = left.withColumns({"_right": F.lit(False), "_carry": F.lit(None).cast(kind)})  # noqa: E741
    r = right.select(*keys, at, F.lit(True).alias("_right"), carry.alias("_carry"))
    both = l.unionByName(r, allowMissingColumns=True)
    # At the same position right rows come first, so that a left row sees them.
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_right").desc(), *(F.col(f"_carry.{v}") for v in value)).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_carry", ignorenulls=True).over(w)).where(~F.col("_right"))
    return filled.select(*left.columns, *(F.col(f"_last.{v}").alias(v) for v in value))


def interval(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges [low, high] that hold them: ranges are dealt to the buckets they touch, so that the join is by equality.

    A bucket in which many points meet many ranges is cut into tiles: a point is in all tiles of one row, a range in
    all of one column, so each pair still meets once, and no task has a whole bucket.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / F.lit(width)))
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / F.lit(width)), F.floor(F.col(high) / F.lit(width)))))
    keys = ["_bucket"]
    counts = p.groupBy("_bucket").agg(F.count("*").alias("_points")).join(r.groupBy("_bucket").agg(F.count("*").alias("_ranges")), "_bucket")
    # Each of these buckets stands for millions of pairs, so there are few.
    hot = counts.where(F.col("_points").cast("double") * F.col("_ranges") > TILE * TILE).select("_bucket", F.ceil(F.col("_points") / TILE).alias("_rows"), F.ceil(F.col("_ranges") / TILE).alias("_columns")).collect()
    if hot:
        spark = points.sparkSession
        keys = ["_bucket", "_row", "_column"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(h["_rows"] * h["_columns"] for h in hot) // TASK_TILES))
        cut = F.broadcast(spark.createDataFrame([tuple(h) for h in hot], "_bucket long, _rows long, _columns long"))
        p, r = (_tiled(df, cut, *sides).repartition(tasks, *keys) for df, *sides in ((p, "_row", "_rows", "_column", "_columns"), (r, "_column", "_columns", "_row", "_rows")))
    return p.join(r, keys).where(F.col(at).between(F.col(low), F.col(high))).drop(*keys)


def _tiled(df: DataFrame, cut: DataFrame, own: str, most: str, other: str, others: str) -> DataFrame:
    """Each row with its own row or column of tiles, once for each tile of it. The place follows from the row's values, so a task that runs again gives the same."""
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"))
    both = df.join(cut, "_bucket", "left").withColumn(own, F.pmod(hashed, F.coalesce(most, F.lit(1))))
    return both.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(others, F.lit(1)) - 1))).drop(most, others)

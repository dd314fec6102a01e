"""Folds over transfer tables (from, to, value as text): balances, exposure, velocity, supply, reserves, flags.

Values beyond DECIMAL(38,0) are null and count nowhere. Every fold is linear in its rows, so
each takes a ``weight`` column where there is one: +1 adds a row, -1 takes it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import BIG, ZERO_ADDRESS, big

BUCKET_BLOCKS = 7200


def _weight(df: DataFrame) -> Column:
    return F.col("weight").cast(BIG) if "weight" in df.columns else F.lit(1).cast(BIG)


def _total(df: DataFrame, value: str) -> Column:
    """The sum of ``value`` over rows made of ``df``'s; rows that are all added need no product of 128-bit numbers each."""
    v = F.col(value)
    return F.sum((v * F.col("weight")).cast(BIG) if "weight" in df.columns else v).cast(BIG)


def _rows(df: DataFrame) -> Column:
    """How many rows are added and not taken back."""
    return F.sum("weight").cast("long") if "weight" in df.columns else F.count("*")


def signed_moves(transfers: DataFrame, lower: bool = False) -> DataFrame:
    """(address, delta, weight): +value for ``to``, -value for ``from``, in one pass over the rows."""
    v = big(F.col("value"))
    sides = F.array(F.struct(F.col("to").alias("address"), v.alias("delta")), F.struct(F.col("from").alias("address"), (-v).alias("delta")))
    moves = transfers.where(v.isNotNull()).select(_weight(transfers).alias("weight"), F.inline(sides))
    return moves.withColumn("address", F.lower("address")) if lower else moves


def net_balances(transfers: DataFrame) -> DataFrame:
    """(address, balance) without zeros; the zero address and the case of addresses stay."""
    moves = signed_moves(transfers)
    total = _total(transfers, "delta")
    return moves.groupBy("address").agg(total.alias("balance")).where("balance <> 0")


def balances(transfers: DataFrame) -> DataFrame:
    """(addr, balance) of holders: lower-cased, without zeros and the zero address."""
    return net_balances(transfers.withColumns({"from": F.lower("from"), "to": F.lower("to")})).where(F.col("address") != ZERO_ADDRESS).withColumnRenamed("address", "addr")


def holder_count(transfers: DataFrame) -> DataFrame:
    return balances(transfers).agg(F.count("*").alias("holders"))


def total_supply(transfers: DataFrame) -> DataFrame:
    """Minted less burned; 0 over no rows."""
    v = (big(F.col("value")) * _weight(transfers)).cast(BIG)
    side = lambda c: F.coalesce(F.sum(F.when(F.lower(F.col(c)) == ZERO_ADDRESS, v)).cast(BIG), F.lit(0).cast(BIG))
    return transfers.agg((side("from") - side("to")).cast(BIG).alias("total_supply"))


def top_balances(found: DataFrame, n: int, key: str = "address") -> DataFrame:
    """The n largest, ties by address."""
    return found.orderBy(F.col("balance").desc(), F.col(key)).limit(n)


def balance_of(found: DataFrame, address: str) -> DataFrame:
    """One address's row, its amount as text; no row where it holds nothing."""
    return found.where(F.lower("address") == address.lower()).select("address", F.col("balance").cast("string").alias("balance"))


def exposure(transfers: DataFrame, labels: DataFrame) -> DataFrame:
    """(address, label, direction, amount, n): what addresses sent to and got from labelled ones.

    ``labels`` (address, label) may repeat rows. A group exists while its count isn't 0, so an amount may be 0.
    """
    marks = labels.select(F.lower("address").alias("counterparty"), "label").distinct()
    v = big(F.col("value"))
    sides = F.array(
        F.struct(F.col("from").alias("address"), F.lower("to").alias("counterparty"), F.lit("out").alias("direction")),
        F.struct(F.col("to").alias("address"), F.lower("from").alias("counterparty"), F.lit("in").alias("direction")),
    )
    moves = transfers.where(v.isNotNull()).select(v.alias("v"), _weight(transfers).alias("weight"), F.inline(sides))
    # Partial sums by address pair come before the join with labels, so that a hot pair moves once.
    pairs = moves.groupBy("address", "counterparty", "direction").agg(_total(transfers, "v").alias("amount"), _rows(transfers).alias("n"))
    return pairs.join(marks, "counterparty").groupBy("address", "label", "direction").agg(F.sum("amount").cast(BIG).alias("amount"), F.sum("n").alias("n")).where("n <> 0")


def exposure_of(found: DataFrame, address: str) -> DataFrame:
    return found.where(F.lower("address") == address.lower()).orderBy(F.col("amount").desc(), "label", "direction")


def bucket(block: Column, width: int = BUCKET_BLOCKS) -> Column:
    """First block of a tumbling window."""
    if width < 1:
        raise ValueError("a window has at least one block")
    return (block - F.pmod(block, F.lit(width))).cast("long")


def velocity(transfers: DataFrame, width: int = BUCKET_BLOCKS) -> DataFrame:
    """(address, window_start, volume, n): what an address sent in each window of blocks."""
    v = big(F.col("value"))
    rows = transfers.where(v.isNotNull()).select(F.col("from").alias("address"), bucket(F.col("block_number"), width).alias("window_start"), v.alias("v"), _weight(transfers).alias("weight"))
    return rows.groupBy("address", "window_start").agg(_total(transfers, "v").alias("volume"), _rows(transfers).alias("n")).where("n <> 0")


def velocity_flags(found: DataFrame, threshold: int) -> DataFrame:
    """Windows at or above the threshold, largest first."""
    return found.where(F.col("volume") >= F.lit(str(threshold)).cast(BIG)).orderBy(F.col("volume").desc(), "address", "window_start")


def threshold_flags(transfers: DataFrame, threshold: int, rule: str) -> DataFrame:
    """A ``threshold_flag`` row for each transfer at or above the threshold."""
    return transfers.where(big(F.col("value")) >= F.lit(str(threshold)).cast(BIG)).select(
        F.lit("threshold").alias("kind"), F.lit(rule).alias("rule"), "from", "to", "value", F.lit(str(threshold)).alias("threshold"), "block_number", "log_index"
    )


def is_large(value: Column, least: int = 10**9) -> Column:
    """Whether a value is at least so large; null counts as no."""
    return F.coalesce(big(value) >= F.lit(str(least)).cast(BIG), F.lit(False))


def latest_reserves(syncs: DataFrame) -> DataFrame:
    """(address, reserve0, reserve1) of each pair's last row: an aggregate, so that no pair is sorted whole."""
    last = F.max_by(F.struct("reserve0", "reserve1"), F.struct("block_number", "log_index"))
    return syncs.groupBy("address").agg(last.alias("r")).select("address", big(F.col("r.reserve0")).alias("reserve0"), big(F.col("r.reserve1")).alias("reserve1"))


def earliest_children(discoveries: DataFrame, timestamps: bool = True) -> DataFrame:
    """Each child's first discovery. ``discoveries`` (child, block_number, log_index, address[, block_timestamp])."""
    carried = ["block_number", "log_index"] + ["block_timestamp"] * timestamps
    rows = discoveries.select(F.lower("child").alias("child"), *carried, F.lower("address").alias("parent_address"))
    first = rows.groupBy("child").agg(F.min(F.struct("block_number", "log_index", *(["block_timestamp"] * timestamps), "parent_address")).alias("f"))
    out = [F.col("child").alias("address"), F.col("f.block_number").alias("discovered_block"), F.col("f.log_index").alias("discovered_log_index")]
    return first.select(*out, *([F.col("f.block_timestamp").alias("discovered_timestamp")] * timestamps), F.col("f.parent_address"))


def range_audit(hits: DataFrame) -> DataFrame:
    """Counts and block range of stored hits."""
    return hits.agg(F.count("*").alias("hits"), F.countDistinct("list_snapshot").alias("lists"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, for orders that aren't total over few rows of a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def bench_stats(samples: DataFrame, column: str) -> DataFrame:
    """Median and nearest-rank 99th percentile of measurements."""
    return samples.agg(F.percentile(column, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY `{column}`)").alias("p99"))

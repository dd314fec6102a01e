"""Views that are kept up by signed rows: +1 adds a row, -1 takes it back.

A view's state is one row for each key; a batch's rows are summed first, so what meets the
state is small. Keys whose existence counter returns to zero are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import BIG
from ledgerloom.operators import folds


@dataclass(frozen=True)
class ViewKind:
    """Keys, summed columns, and which of these says that a key exists."""

    keys: tuple[str, ...]
    sums: tuple[str, ...]
    exists: str


BALANCE = ViewKind(("address",), ("balance",), "balance")
EXPOSURE = ViewKind(("address", "label", "direction"), ("amount", "n"), "n")
VELOCITY = ViewKind(("address", "window_start"), ("volume", "n"), "n")


def with_weight(rows: DataFrame, weight: int) -> DataFrame:
    return rows.withColumn("weight", F.lit(weight))


def merge(kind: ViewKind, state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state after a delta of the same shape."""
    both = state.select(*kind.keys, *kind.sums).unionByName(delta.select(*kind.keys, *kind.sums))
    types = dict(state.dtypes)
    total = both.groupBy(*kind.keys).agg(*(F.sum(c).cast(BIG if types[c].startswith("decimal") else types[c]).alias(c) for c in kind.sums))
    return total.where(F.col(kind.exists) != 0)


def balance_delta(rows: DataFrame) -> DataFrame:
    """Signed sums by address; like a fold, but over weighted rows."""
    return folds.net_balances(rows)


def exposure_delta(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Signed sums; groups whose count cancels may still carry an amount, so none are dropped here."""
    signed = rows.select("*")
    plus, minus = (folds.exposure(signed.where(F.col("weight") == w).drop("weight"), labels) for w in (1, -1))
    negative = minus.withColumns({"amount": (-F.col("amount")).cast(BIG), "n": -F.col("n")})
    return plus.unionByName(negative).groupBy("address", "label", "direction").agg(F.sum("amount").cast(BIG).alias("amount"), F.sum("n").alias("n"))


def velocity_delta(rows: DataFrame, width: int) -> DataFrame:
    plus, minus = (folds.velocity(rows.where(F.col("weight") == w).drop("weight"), width) for w in (1, -1))
    negative = minus.withColumns({"volume": (-F.col("volume")).cast(BIG), "n": -F.col("n")})
    return plus.unionByName(negative).groupBy("address", "window_start").agg(F.sum("volume").cast(BIG).alias("volume"), F.sum("n").alias("n"))


def warm_balances(cold: DataFrame, hot: DataFrame, sealed_through: int) -> DataFrame:
    """Balances after a restart: a fold of sealed rows and one of hot rows above the watermark, put together.

    Rows that are still hot although they were sealed count once."""
    seed = folds.net_balances(cold.where(F.col("block_number") <= sealed_through))
    return merge(BALANCE, seed, folds.net_balances(hot.where(F.col("block_number") > sealed_through)))

"""Screening transfers against address lists, and checking stored hits by screening again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT_COLUMNS = ("block_number", "log_index", "address", "side", "counterparty", "value")


def scrape_addresses(texts: DataFrame, column: str = "text") -> DataFrame:
    """(address): 0x and exactly 40 hex digits in free text, lower-cased, distinct."""
    found = F.explode(F.regexp_extract_all(F.col(column), F.lit("0[xX][0-9a-fA-F]*"), F.lit(0)))
    return texts.select(found.alias("a")).where(F.length("a") == 42).select(F.lower("a").alias("address")).distinct()


def screen(transfers: DataFrame, listed: DataFrame) -> DataFrame:
    """A hit for each side of a transfer that is on the list.

    The list isn't assumed to be small: the engine broadcasts it only where its size is known to allow that.
    """
    names = listed.select(F.lower("address").alias("address")).distinct()
    sides = F.array(
        F.struct(F.lower("from").alias("address"), F.lit("from").alias("side"), F.lower("to").alias("counterparty")),
        F.struct(F.lower("to").alias("address"), F.lit("to").alias("side"), F.lower("from").alias("counterparty")),
    )
    rows = transfers.select("block_number", "log_index", "value", F.inline(sides))
    return rows.join(names, "address", "left_semi").select(*HIT_COLUMNS)


def hit_rows(hits: DataFrame, snapshot: str, source: str) -> DataFrame:
    """``sanction_hit`` annotation rows."""
    return hits.withColumns({"list_snapshot": F.lit(snapshot), "source": F.lit(source)})


def audit_diff(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Hits of only one side: ``missing`` ones should be stored, ``extra`` ones shouldn't. Repetitions count."""
    a, b = stored.select(*HIT_COLUMNS), again.select(*HIT_COLUMNS)
    return b.exceptAll(a).withColumn("fault", F.lit("missing")).unionByName(a.exceptAll(b).withColumn("fault", F.lit("extra")))


def backfill(spark, store, transfers: DataFrame, listed: DataFrame, snapshot: str, source: str, first: int, last: int):
    """Screen a sealed range and seal its hits; a range that was sealed with the same rows is left as it is."""
    hits = hit_rows(screen(transfers.where(F.col("block_number").between(first, last)), listed), snapshot, source)
    return store.seal(spark, {"sanction_hit": hits}, first, last)

"""Ledger facts over the star-schema tables: which columns stand for transfers, syncs, discoveries and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` where it's a table too small for a split a core.

    A file of one row group is one task, however much is made of its rows. A table that has a full
    split for each core stays as it is: its scan is spread already and a shuffle would add nothing.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores, key) if size < cores * split else df


def address(key: Column) -> Column:
    """A key as an address; key 0 is the zero address."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(key.cast("long"))), 40, "0"))


def cents(amount: Column) -> Column:
    """Money as whole numbers in text."""
    return F.round(amount * 100).cast("long").cast("string")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_number, log_index, from, to, value): what a supplier ships to a customer."""
    line = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice"), "l_orderkey")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("block_number"), F.col("l_linenumber").cast("long").alias("log_index"), address(F.col("l_suppkey")).alias("from"), address(F.col("o_custkey")).alias("to"), cents(F.col("l_extendedprice")).alias("value")
    )


#: The same for DuckDB.
TRANSFERS = """t AS (SELECT o_orderkey AS block_number, l_linenumber::BIGINT AS log_index, printf('0x%040x', l_suppkey) AS "from", printf('0x%040x', o_custkey) AS "to",
  round(l_extendedprice * 100)::BIGINT::VARCHAR AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block_number, log_index, from, to, value, event_type): events as outbound transfers in blocks of 12 seconds."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.floor(seconds / 12).cast("long").alias("block_number"), F.col("event_id").alias("log_index"), address(F.col("user_id")).alias("from"), address(F.col("event_id") % 7).alias("to"), cents(F.col("value")).alias("value"), "event_type"
    )


EVENTS = """e AS (SELECT epoch_us(ts) // 12000000 AS block_number, event_id AS log_index, printf('0x%040x', user_id) AS "from", printf('0x%040x', event_id % 7) AS "to",
  round(value * 100)::BIGINT::VARCHAR AS value, event_type FROM events)"""


def syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, block_number, log_index, reserve0, reserve1): orders as reserve updates of a customer's pair."""
    o = table(spark, sf_dir, "orders")
    return o.select(address(F.col("o_custkey")).alias("address"), F.col("o_orderkey").alias("block_number"), F.length("o_orderpriority").cast("long").alias("log_index"), cents(F.col("o_totalprice")).alias("reserve0"), F.col("o_orderkey").cast("string").alias("reserve1"))


def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, label): each supplier under its region's name. A supplier's address may be a customer's too."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(address(F.col("s_suppkey")).alias("address"), F.col("r_name").alias("label"))


LABELS = """l AS (SELECT DISTINCT printf('0x%040x', s_suppkey) AS address, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def transfer_topic() -> str:
    """First topic of a transfer's log."""
    from ledgerloom.functions.keccak import keccak256

    return "0x" + keccak256(b"Transfer(address,address,uint256)").hex()


def transfer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs whose decoding gives the transfers again."""
    topic0 = transfer_topic()
    word = lambda c: F.concat(F.lit("0x"), F.lpad(F.substring(c, 3, 64), 64, "0"))
    t = transfers(spark, sf_dir)
    return t.select(
        F.lit(TOKEN).alias("address"), F.array(F.lit(topic0), word(F.col("from")), word(F.col("to"))).alias("topics"), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.col("value").cast("long"))), 64, "0")).alias("data"),
        "block_number", F.lit("0xb").alias("block_hash"), F.col("block_number").alias("block_timestamp"), F.lit("0xt").alias("tx_hash"), "log_index",
    )


TOKEN = "0x" + "ab" * 20
TRANSFER_ABI = [{"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}]

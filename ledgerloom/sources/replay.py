"""Log sources: what a source must offer, a scripted one, and a Spark data source that replays files of windows."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ledgerloom.operators.decode import LOG_SCHEMA, log_filter


class LogSource(ABC):
    """A chain as far as ingestion needs it. Frames are lazy; only tips and hashes come to the driver."""

    @abstractmethod
    def tip(self) -> int: ...

    @abstractmethod
    def finalized(self) -> int | None: ...

    @abstractmethod
    def block_hash(self, block: int) -> str | None: ...

    @abstractmethod
    def headers(self, first: int, last: int) -> DataFrame: ...

    @abstractmethod
    def logs(self, addresses: list[str], topics: list[str], first: int, last: int) -> DataFrame: ...


@dataclass
class FrameSource(LogSource):
    """A source over a table of logs and one of block headers (block_number, block_hash, block_timestamp, ...)."""

    log_rows: DataFrame
    header_rows: DataFrame
    final: int | None = None

    def tip(self) -> int:
        from pyspark.sql import functions as F

        return self.header_rows.agg(F.max("block_number").alias("m")).first()["m"] or 0

    def finalized(self) -> int | None:
        return self.final

    def block_hash(self, block: int) -> str | None:
        row = self.header_rows.where(f"block_number = {int(block)}").first()
        return row["block_hash"] if row else None

    def headers(self, first: int, last: int) -> DataFrame:
        return self.header_rows.where(f"block_number BETWEEN {int(first)} AND {int(last)}")

    def logs(self, addresses: list[str], topics: list[str], first: int, last: int) -> DataFrame:
        return log_filter(self.log_rows.where(f"block_number BETWEEN {int(first)} AND {int(last)}"), addresses, topics)


@dataclass
class PushSource:
    """A feed of commits and reverts that another part of the process pushes."""

    queue: list[tuple[str, object]] = field(default_factory=list)

    def commit(self, logs: DataFrame, first: int, last: int) -> None:
        self.queue.append(("commit", (logs, first, last)))

    def revert(self, block: int) -> None:
        self.queue.append(("revert", block))

    def drain(self) -> list[tuple[str, object]]:
        out, self.queue = self.queue, []
        return out


@dataclass
class _Window(InputPartition):
    lines: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        lines = json.loads(self.options["logs"])
        step = max(1, -(-len(lines) // int(self.options.get("partitions", 4))))
        return [_Window(lines[a : a + step]) for a in range(0, len(lines), step)] or [_Window([])]

    def read(self, partition):
        for r in partition.lines:
            yield tuple(r)


class _StreamReader(SimpleDataSourceStreamReader):
    """Windows of blocks as micro-batches; the offset is the next block."""

    def __init__(self, options: dict):
        self.rows = json.loads(options["logs"])
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 0))
        self.step = max(1, int(options.get("window", 100)))

    def initialOffset(self):
        return {"block": self.first}

    def read(self, start):
        end = min(start["block"] + self.step, self.last + 1)
        return iter([tuple(r) for r in self.rows if start["block"] <= r[3] < end]), {"block": max(end, start["block"])}

    def readBetweenOffsets(self, start, end):
        return iter([tuple(r) for r in self.rows if start["block"] <= r[3] < end["block"]])


class ReplaySource(DataSource):
    """``ledger_replay``: logs given as JSON rows, for batches and streams. Options: logs, first, last, window."""

    @classmethod
    def name(cls) -> str:
        return "ledger_replay"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplaySource)


def sampled_blocks(spark: SparkSession, first: int, last: int, every: int) -> DataFrame:
    """Blocks of a range at which a pinned read is due: multiples of ``every``, whatever the range."""
    start = -(-first // every) * every
    return spark.range(start, last + 1, every).withColumnRenamed("id", "block_number")


def row_driven_reads(rows: DataFrame, contract: str, template: list[str]) -> DataFrame:
    """(block_number, contract, args): one read for each distinct row and block; ``{col}`` takes a column's value."""
    from pyspark.sql import functions as F

    take = lambda t: F.col(t[1:-1]).cast("string") if t.startswith("{") and t.endswith("}") else F.lit(t)
    target = F.col(contract[1:-1]) if contract.startswith("{") else F.lit(contract)
    return rows.select("block_number", F.lower(target).alias("contract"), F.array(*map(take, template)).cast("array<string>").alias("args")).dropDuplicates()


def call_address(chain_id: int, block, contract, calldata):
    """Content address of a pinned read: a hash of big-endian numbers and texts, kept apart by a byte that neither has."""
    from pyspark.sql import functions as F

    number = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    cut = F.unhex(F.lit("1F"))
    return F.sha2(F.concat(number(F.lit(chain_id)), cut, number(block), cut, contract.cast("binary"), cut, calldata.cast("binary")), 256)

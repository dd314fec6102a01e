"""Ingestion in micro-batches: reorganisations, finality, sealing, alerts and delivery.

Each micro-batch is a window of blocks. It is committed together with its cursor under the
batch's number, so that a batch that runs again changes nothing. Late data differ from event
time watermarks: a change above the watermark is taken back and redone, one below it stops the
stream, because sealed rows are final.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.store import FinalityFault, Store, running_counts

OUTBOX_ROWS = 10_000
COLD_START = 5_000


def watermark(tip: int, depth: int, finalized: int | None = None) -> int:
    """Last block that counts as final: the chain's own word where there is one (never beyond the tip), else tip less depth."""
    return max(-1, min(finalized, tip) if finalized is not None else tip - depth)


def start_block(tip: int, backfill: int | None = None, starts: list[int] = ()) -> int:
    """First block of a cold start."""
    if backfill is not None:
        return max(0, tip - backfill)
    return min(min(starts), tip) if starts else max(0, tip - COLD_START)


def resume_block(store: Store) -> int | None:
    """First block after what is there; None for an empty store."""
    s = store.state()
    found = max(s.cursor, s.sealed_through)
    return found + 1 if found >= 0 else None


def reorg_point(checkpoints: DataFrame, canonical: DataFrame) -> int | None:
    """The deepest block that both agree in, if any checkpoint differs; 0 if none agrees; None if there was no reorganisation."""
    both = checkpoints.select("block_number", F.col("block_hash").alias("seen")).join(canonical.select("block_number", F.col("block_hash").alias("now")), "block_number", "left")
    row = both.agg(F.max(F.when(~F.col("seen").eqNullSafe(F.col("now")), F.col("block_number"))).alias("off"), F.max(F.when(F.col("seen") == F.col("now"), F.col("block_number"))).alias("same")).first()
    return None if row["off"] is None else int(row["same"] or 0)


@dataclass
class WindowSize:
    """How many blocks to ask for next: towards ``target`` logs, in damped steps, and back at once when refused."""

    target: int = 2_000
    most: int = 100_000
    size: int = 100
    proven: int = 0

    def grew(self, blocks: int, logs: int) -> int:
        self.proven = max(self.proven, blocks)
        wanted = blocks * self.target // max(1, logs)
        self.size = max(1, min(wanted, 4 * blocks, 4 * self.proven, self.most))
        return self.size

    def refused(self) -> int:
        self.size = max(1, self.size // 2)
        self.proven = min(self.proven, self.size)
        return self.size


def fetch_split(fetch: Callable[[int, int], DataFrame], first: int, last: int, refusal: type[Exception]) -> Iterator[tuple[int, int, DataFrame]]:
    """Windows of a range; what the source refuses is halved, down to one block."""
    todo = [(first, last)]
    while todo:
        a, b = todo.pop()
        try:
            yield a, b, fetch(a, b)
        except refusal:
            if a == b:
                raise
            middle = (a + b) // 2
            todo += [(middle + 1, b), (a, middle)]


@dataclass
class Dataset:
    """What one dataset does with a window: its store, decoding to tables, and annotations."""

    store: Store
    decode: Callable[[DataFrame], dict[str, DataFrame]]
    names: dict[str, list[str]]
    annotate: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None
    on_change: list[Callable[[dict[str, DataFrame], int], None]] = field(default_factory=list)
    fault: Exception | None = None


def apply_window(dataset: Dataset, logs: DataFrame, checkpoints: dict[int, str], cursor: int, batch: int) -> None:
    """Decode, annotate, commit; then tell the views, with weight +1."""
    tables = dataset.decode(logs)
    if dataset.annotate:
        tables = {**tables, **dataset.annotate(tables)}
    before = dataset.store.state().batch
    dataset.store.commit_window(tables, checkpoints, cursor, batch)
    if batch > before:
        for tell in dataset.on_change:
            tell(tables, 1)


def revert_to(dataset: Dataset, block: int) -> None:
    """Take back what is above a block, and tell the views with weight -1. Below the watermark this is a fault that stays."""
    try:
        _, gone = dataset.store.rollback(block, dataset.names)
    except FinalityFault as e:
        dataset.fault = e
        raise
    for tell in dataset.on_change:
        tell(gone, -1)


def check_late(dataset: Dataset, logs: DataFrame) -> None:
    """New rows at or below the watermark stop the stream; they must not be dropped silently."""
    sealed = dataset.store.state().sealed_through
    late = logs.where(F.col("block_number") <= sealed).limit(1).collect()
    if late:
        dataset.fault = FinalityFault(f"rows of block {late[0]['block_number']} came after {sealed} was final")
        raise dataset.fault


@dataclass
class Chain:
    """What the source now says: hashes of blocks, and the logs of a range of blocks."""

    hashes: Callable[[list[int]], dict[int, str]]
    logs: Callable[[int, int], DataFrame]


def follow_reorg(dataset: Dataset, chain: Chain) -> DataFrame | None:
    """Take back what the chain no longer holds, and return the logs that it holds instead up to the cursor; None if all is as it was.

    Checkpoints are one for each window above the watermark and one below, so few. Where the chain
    differs below the watermark too, taking back is a fault.
    """
    state = dataset.store.state()
    held = {int(b): h for b, h in state.checkpoints.items()}
    final = [b for b in held if b <= state.sealed_through]
    seen = {b: h for b, h in held.items() if b > state.sealed_through or b == max(final)}
    now = chain.hashes(sorted(seen)) if seen else {}
    if all(now.get(b) == h for b, h in seen.items()):
        return None
    point = max((b for b, h in seen.items() if now.get(b) == h), default=max(state.sealed_through, 0) - 1 if final else 0)
    top = state.cursor
    revert_to(dataset, point)
    return chain.logs(point + 1, top) if top > point else None


def for_each_batch(datasets: list[Dataset], hashes: Callable[[DataFrame], dict[int, str]], chain: Chain | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: one fetch feeds all datasets. A dataset that fails, for whatever reason, is set
    aside with its fault; the others go on, and the stream stops when none is left.

    With ``chain`` each batch first looks whether the blocks of earlier windows are still the chain's: what
    isn't is taken back, and its blocks are applied anew together with the batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            top = batch.agg(F.max("block_number").alias("m")).first()["m"]
            if top is None:
                return
            seen = hashes(batch)
            for d in datasets:
                if d.fault is not None:
                    continue
                try:
                    again = follow_reorg(d, chain) if chain and number > d.store.state().batch else None
                    logs = batch if again is None else again.join(batch.select("block_number").distinct(), "block_number", "left_anti").unionByName(batch)
                    check_late(d, logs)
                    apply_window(d, logs, seen, int(top), number)
                except Exception as e:  # noqa: BLE001  the others must go on
                    d.fault = d.fault or e
            if datasets and all(d.fault for d in datasets):
                raise datasets[0].fault
        finally:
            batch.unpersist()

    return run


def block_hashes(batch: DataFrame) -> dict[int, str]:
    """Hash of the window's last block: one checkpoint for each window is enough to find a reorganisation."""
    row = batch.agg(F.max(F.struct("block_number", "block_hash")).alias("m")).first()["m"]
    return {int(row["block_number"]): row["block_hash"]} if row else {}


# -- alerts and delivery


@dataclass
class Outbox:
    """Alerts to deliver at least once, in order; a full box refuses more rather than forget some."""

    spark: SparkSession
    path: str
    most: int = OUTBOX_ROWS

    def pending(self) -> DataFrame:
        schema = "id string, kind string, body string"
        from ledgerloom.sources.store import Files

        files = Files(self.spark, self.path)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows") if files.exists("rows") else self.spark.createDataFrame([], schema)
        done = self.spark.read.schema("id string").parquet(f"{self.path}/done") if files.exists("done") else self.spark.createDataFrame([], "id string")
        return rows.dropDuplicates(["id"]).join(done.distinct(), "id", "left_anti")

    def put(self, flags: DataFrame, weight: int, key: list[str], batch: int) -> None:
        """``flag`` for rows that came with a batch, ``flag_retracted`` for rows that one took back.

        The batch is part of an alert's id: a batch that runs again adds nothing, and a flag that comes
        back on another branch is another alert.
        """
        kind = "flag" if weight > 0 else "flag_retracted"
        rows = flags.select(F.sha2(F.concat_ws("|", F.lit(kind), F.lit(str(batch)), *(F.col(c).cast("string") for c in key)).cast("binary"), 256).alias("id"), F.lit(kind).alias("kind"), F.to_json(F.struct(*flags.columns)).alias("body"))
        if self.pending().count() + rows.count() > self.most:
            raise OverflowError(f"more than {self.most} alerts wait")
        rows.write.mode("append").parquet(f"{self.path}/rows")

    def deliver(self, send: Callable[[str, str], bool]) -> int:
        """Send what waits; what is sent is marked afterwards, so a crash in between sends it again."""
        sent = [r["id"] for r in self.pending().orderBy("id").limit(self.most).collect() if send(r["kind"], r["body"])]
        if sent:
            self.spark.createDataFrame([(i,) for i in sent], "id string").write.mode("append").parquet(f"{self.path}/done")
        return len(sent)


def sealed_chunks(rows: DataFrame, cursor: int, sealed: int, where: str | None = None, size: int = 50) -> DataFrame:
    """(chunk, seq, row): rows in (cursor, sealed] that a condition takes, in chain order, in chunks."""
    from pyspark.sql import Window

    mine = rows.where((F.col("block_number") > cursor) & (F.col("block_number") <= sealed))
    if where:
        mine = mine.where(where)
    # Blocks get their place from counts by block; only within a block are rows numbered.
    before = running_counts(mine, "k")
    inside = F.row_number().over(Window.partitionBy("block_number").orderBy("log_index", F.to_json(F.struct(*mine.columns))))
    placed = mine.withColumn("i", inside).join(before.drop("k"), "block_number").withColumn("seq", F.col("before") + F.col("i") - 1)
    return placed.select(F.floor(F.col("seq") / size).alias("chunk"), "seq", F.to_json(F.struct(*mine.columns)).alias("row"))


def webhook_start(kind: str | int, sealed: int) -> int:
    """Cursor of a new webhook: from its registration, from the beginning, or from a block on."""
    if kind == "registration":
        return sealed
    if kind == "genesis":
        return -1
    return int(kind) - 1


def sign(secret: bytes, body: bytes) -> str:
    """What a receiver checks a delivery by."""
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def deliver_sealed(rows: DataFrame, cursor: int, sealed: int, send: Callable[[bytes], bool], where: str | None = None, size: int = 50) -> int:
    """Send chunks in order until one isn't taken; the new cursor is the last block that is wholly sent."""
    at, held, chunk = cursor, [], None
    for r in sealed_chunks(rows, cursor, sealed, where, size).orderBy("seq").toLocalIterator():
        if chunk is not None and r["chunk"] != chunk:
            if not send(("[" + ",".join(held) + "]").encode()):
                return at
            at, held = max(at, json.loads(held[-1])["block_number"] - 1), []
        chunk = r["chunk"]
        held.append(r["row"])
    if held and not send(("[" + ",".join(held) + "]").encode()):
        return at
    return sealed


# -- state by key


def recurrence(rows: DataFrame, key: str = "address") -> DataFrame:
    """Each row with how often its key has come so far, in chain order."""
    from pyspark.sql import Window

    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy("block_number", "log_index")))


def recurrence_stream(rows: DataFrame, key: str = "address") -> DataFrame:
    """The same over a stream: the count of each key is kept as state."""
    import pandas as pd

    names = rows.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", occurrence long"

    def count(_, frames, state):
        seen = state.get[0] if state.exists else 0
        for f in frames:
            f = f.sort_values(["block_number", "log_index"], kind="stable")
            out = f[names].assign(occurrence=range(seen + 1, seen + 1 + len(f)))
            seen += len(f)
            yield pd.DataFrame(out)
        state.update((seen,))

    return rows.groupBy(key).applyInPandasWithState(count, schema, "seen long", "append", "NoTimeout")


def ensure_running(query) -> None:
    """A stream that died must not go on being served as if it were fresh."""
    if query.exception() is not None:
        raise RuntimeError("the stream has stopped") from query.exception()

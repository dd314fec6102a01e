"""Hot and sealed rows: Parquet segments with a manifest, a movable tip, and one watermark.

Sealed segments never change; their names are hashes of their rows, so sealing the same rows
again gives the same segment. Hot rows are in versioned folders that the state file names. The
state file (manifest, watermark, hot versions) is replaced in one rename, so a reader sees a
commit whole or not at all. All files are reached through Hadoop's file system interface.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.columns import IMPLICIT, conform, empty_table, with_big_columns

MOST_HOT_ROWS = 2_000_000
SEAL_ROWS = 20_000
#: Most rows that a file of a segment has, about, and the fewest that are worth a task of their own.
FILE_ROWS, TASK_ROWS = 5_000_000, 1_000_000


class HotScanTooLarge(RuntimeError):
    pass


class CorruptSegment(RuntimeError):
    pass


class FinalityFault(RuntimeError):
    """A change below the watermark: sealed rows can't be taken back."""


@dataclass(frozen=True)
class Segment:
    hash: str
    from_block: int
    to_block: int
    rows: int
    file: str
    columns: list[str] | None = None


@dataclass
class State:
    tables: dict[str, list[Segment]] = field(default_factory=dict)
    sealed_through: int = -1
    hot: dict[str, list[str]] = field(default_factory=dict)  # table -> folders
    checkpoints: dict[str, str] = field(default_factory=dict)  # block -> hash
    cursor: int = -1
    batch: int = -1
    version: int = 0


class Files:
    """The file system that a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside the old one, then put it in its place."""
        part = f"{name}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri())
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context.rename(self._path(part), self._path(name), options)

    def move(self, old: str, new: str) -> bool:
        self.fs.mkdirs(self._path(new).getParent())
        return self.fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def rows_hash(df: DataFrame) -> str:
    """A hash of the rows that doesn't depend on their order, on files or on writers: added digests of canonical rows."""
    return _rows_name(sorted(df.columns), _digest_sums(df).first())


def _digest_sums(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each key, the number of rows and the sums of the eight words of their digests: 64 bits hold a task's, all are added exactly."""
    names = sorted(c for c in df.columns if c not in by)
    canon = F.to_json(F.array(*(F.col(f"`{n}`").cast("string") for n in names)), {"ignoreNullFields": "false"})
    words = [f"_word{k}" for k in range(8)]
    digest = df.select(*by, F.spark_partition_id().alias("_task"), F.sha2(canon.cast("binary"), 256).alias("_digest"))
    tasks = digest.groupBy(*by, "_task").agg(F.count("*").alias("_rows"), *(F.sum(F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long")).alias(w) for k, w in enumerate(words)))
    return tasks.groupBy(*by).agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"), *(F.sum(F.col(w).cast("decimal(38,0)")).alias(w) for w in words))


def _rows_name(names: list[str], sums) -> str:
    return hashlib.sha256(json.dumps([names, *map(str, sums)]).encode()).hexdigest()


def _place(at: str, ends: list[int]) -> Column:
    """Number of the range that holds a block, by the last blocks of adjoining ranges."""
    if len(ends) == 1:
        return F.lit(0)
    import numpy as np
    import pandas as pd

    bounds = np.array(ends, dtype="int64")

    def place(blocks):
        return pd.Series(np.searchsorted(bounds, blocks).astype("int32"))

    place.__annotations__ = {"blocks": pd.Series, "return": pd.Series}
    return F.pandas_udf(place, "int")(at)


class Store:
    """The rows of one dataset below ``root``. ``shared`` holds segments that several datasets may use."""

    def __init__(self, spark: SparkSession, root: str, shared: str | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)
        self.shared = (shared or f"{root}").rstrip("/")
        self.shared_files = Files(spark, self.shared)

    # -- state

    def state(self) -> State:
        if not self.files.exists("state.json"):
            return State()
        raw = json.loads(self.files.read("state.json"))
        raw["tables"] = {t: [Segment(**s) for s in segments] for t, segments in raw["tables"].items()}
        return State(**raw)

    def _commit(self, state: State) -> State:
        state.version += 1
        self.files.replace("state.json", json.dumps(asdict(state), sort_keys=True))
        return state

    # -- sealed rows

    def seal(self, spark: SparkSession, tables: dict[str, DataFrame], first: int, last: int, advance: bool = False) -> State:
        """One segment for each table that has rows in the range; a range with the same rows is left as it is."""
        state = self.state()
        self._add_segments(state, tables, [(first, last)])
        if advance:
            state.sealed_through = max(state.sealed_through, last)
        return self._commit(state)

    def _add_segments(self, state: State, tables: dict[str, DataFrame], ranges: list[tuple[int, int]]) -> None:
        """To the state, one segment for each table and each of the adjoining ranges in which it has rows.

        However many ranges there are, a table's rows are read once for all hashes and once (and for
        a sample) for all files.
        """
        for table, df in sorted(tables.items()):
            rows = df.where(F.col("block_number").between(ranges[0][0], ranges[-1][1])).drop("table")
            placed, names = rows.withColumn("_range", _place("block_number", [b for _, b in ranges])), sorted(rows.columns)
            found = {r[0]: (r[1], _rows_name(names, r[1:])) for r in _digest_sums(placed, ("_range",)).collect()}
            held = state.tables.setdefault(table, []) if found else []
            known = {s.hash for s in held}
            new = {k: (count, key) for k, (count, key) in sorted(found.items()) if key not in known}
            missing = {k: v for k, v in new.items() if not self.shared_files.exists(f"segments/{v[1]}.parquet")}
            if missing:
                self._write_segments(placed if len(missing) == len(found) else placed.where(F.col("_range").isin(list(missing))), missing)
            held += [Segment(key, *ranges[k], count, f"segments/{key}.parquet", rows.columns) for k, (count, key) in new.items()]

    def _write_segments(self, placed: DataFrame, found: dict[int, tuple[int, str]]) -> None:
        """A folder of sorted files for each range, in one job; then each gets its name."""
        part = f"segments/.{uuid.uuid4().hex}"
        rows = sum(count for count, _ in found.values())
        files = max(rows // FILE_ROWS, min(max(len(found), rows // TASK_ROWS), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        order = ["_range", "block_number", "log_index"]
        placed.repartitionByRange(files, *order).sortWithinPartitions(*order).write.partitionBy("_range").parquet(f"{self.shared}/{part}")
        for k, (_, key) in found.items():
            self.shared_files.move(f"{part}/_range={k}", f"segments/{key}.parquet")
        self.shared_files.delete(part)

    def seal_and_prune(self, ceiling: int, names: dict[str, list[str]], size: int | None = None) -> State:
        """Hot rows up to the ceiling become segments; then they leave the hot side and the watermark moves, in one commit.

        With ``size`` only whole ranges of ``seal_cuts`` over the rows of all tables are sealed, a segment for
        each; what comes after the last one stays hot. Segments then don't depend on when sealing ran.
        """
        state = self.state()
        if ceiling <= state.sealed_through:
            return state
        hot = {t: self.hot(t, names[t]) for t in state.hot if t in names}
        first = state.sealed_through + 1
        ranges = [(first, ceiling)]
        if size is not None:
            blocks = None
            for df in hot.values():
                own = df.where(F.col("block_number").between(first, ceiling)).select("block_number")
                blocks = own if blocks is None else blocks.unionByName(own)
            ends = sorted(r["last_block"] for r in seal_ranges(blocks, size, sum(s.rows for held in state.tables.values() for s in held)).collect()) if blocks is not None else []
            if not ends:
                return state
            ranges, ceiling = list(zip([first, *(e + 1 for e in ends)], ends)), ends[-1]
        self._add_segments(state, hot, ranges)
        for table, df in hot.items():
            state.hot[table] = self._rewrite(table, df.where(F.col("block_number") > ceiling))
        state.sealed_through = ceiling
        return self._commit(state)

    def segments(self, table: str, first: int | None = None, last: int | None = None, state: State | None = None) -> list[Segment]:
        """Segments up to the watermark whose blocks meet [first, last]."""
        state = state or self.state()
        return [s for s in state.tables.get(table, []) if s.to_block <= state.sealed_through and (last is None or s.from_block <= last) and (first is None or s.to_block >= first)]

    def cold(self, table: str, names: list[str], first: int | None = None, last: int | None = None, without: frozenset = frozenset(), state: State | None = None) -> DataFrame | None:
        """Sealed rows by name: columns that a segment lacks are null. None where there is no segment."""
        found = [s for s in self.segments(table, first, last, state) if s.hash not in without]
        if not found:
            return None
        # Segments share a schema as long as their columns do; each schema is one scan over all its files.
        by_columns: dict[tuple, list[str]] = {}
        for s in found:
            path = f"{self.shared}/{s.file}"
            by_columns.setdefault(tuple(sorted(s.columns or self.spark.read.parquet(path).columns)), []).append(path)
        out = None
        for paths in by_columns.values():
            part = conform(self.spark.read.parquet(*paths), names)
            out = part if out is None else out.unionByName(part)
        return out

    # -- hot rows

    def _rewrite(self, table: str, df: DataFrame) -> list[str]:
        folder = f"hot/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return [folder]

    def hot(self, table: str, names: list[str], most: int | None = None, state: State | None = None) -> DataFrame:
        """Rows above the watermark and those that nobody sealed yet."""
        state = state or self.state()
        folders = state.hot.get(table, [])
        if not folders:
            return empty_table(self.spark, names)
        # Folders of a window each; their schemas may differ.
        parts = [conform(self.spark.read.parquet(f"{self.root}/{f}"), names) for f in folders]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if most is not None and df.limit(most + 1).count() > most:
            raise HotScanTooLarge(f"{table} has more than {most} hot rows")
        return df

    def commit_window(self, tables: dict[str, DataFrame], checkpoints: dict[int, str], cursor: int, batch: int) -> State:
        """Rows, checkpoints and cursor of a window in one commit; a batch that was committed before changes nothing."""
        state = self.state()
        if batch <= state.batch:
            return state
        for table, df in sorted(tables.items()):
            state.hot.setdefault(table, []).extend(self._rewrite(table, df.drop("table")))
        state.checkpoints |= {str(b): h for b, h in checkpoints.items()}
        state.cursor, state.batch = cursor, batch
        return self._commit(state)

    def rollback(self, block: int, names: dict[str, list[str]]) -> tuple[State, dict[str, DataFrame]]:
        """Take back hot rows and checkpoints above a block; the rows come back for retraction. Below the watermark that is a fault."""
        state = self.state()
        if block < state.sealed_through:
            raise FinalityFault(f"block {block} is below the watermark {state.sealed_through}")
        gone = {}
        for table in list(state.hot):
            df = self.hot(table, names[table], state=state)
            gone[table] = df.where(F.col("block_number") > block)
            state.hot[table] = self._rewrite(table, df.where(F.col("block_number") <= block))
        state.checkpoints = {b: h for b, h in state.checkpoints.items() if int(b) <= block}
        state.cursor = min(state.cursor, block)
        return self._commit(state), gone

    # -- both

    def view(self, table: str, names: list[str], big: list[str] = (), most_hot: int | None = None, without: frozenset = frozenset()) -> DataFrame:
        """Sealed and hot rows as one table, without overlap: hot ones count above the watermark, or all where nothing is sealed.

        ``most_hot`` is for what answers callers, which refuses a large tip; a job reads it whole.
        """
        state = self.state()
        cold, hot = self.cold(table, names, without=without, state=state), self.hot(table, names, most_hot, state)
        sealed = bool(self.segments(table, state=state))
        df = union_view(cold, hot, state.sealed_through if sealed else None)
        return with_big_columns(df, list(big))

    # -- integrity

    def damaged(self, tables: list[str] | None = None) -> list[tuple[str, Segment, str]]:
        """Segments of the tables whose rows don't have their hash, and why."""
        state, out = self.state(), []
        for table, segments in state.tables.items():
            for s in segments if tables is None or table in tables else []:
                try:
                    found = rows_hash(self.spark.read.parquet(f"{self.shared}/{s.file}"))
                    if found != s.hash:
                        out.append((table, s, "other rows"))
                except Exception as e:  # noqa: BLE001  whatever the reader says, the segment can't be used
                    out.append((table, s, type(e).__name__))
        return out

    def quarantine(self) -> list[Segment]:
        """Move damaged segments aside, unless they are shared, and take them out of the manifest."""
        state, bad = self.state(), self.damaged()
        for table, s, _ in bad:
            state.tables[table] = [x for x in state.tables[table] if x.hash != s.hash]
            if self.shared == self.root and self.shared_files.exists(s.file):
                self.shared_files.move(s.file, f"quarantine/{s.hash}-{int(time.time())}.parquet")
        if bad:
            self._commit(state)
        return [s for _, s, _ in bad]


def union_view(cold: DataFrame | None, hot: DataFrame, sealed_through: int | None) -> DataFrame:
    """Union by name; with a watermark only hot rows above it."""
    if cold is None:
        return hot
    fresh = hot if sealed_through is None else hot.where(F.col("block_number") > sealed_through)
    return cold.unionByName(fresh, allowMissingColumns=True)


def running_counts(rows: DataFrame, n: str = "n") -> DataFrame:
    """(block_number, n, before): rows of each block, and how many there are in earlier blocks.

    Blocks are dealt by ranges; each range's total, one row a partition, is added to running counts within it.
    """
    from pyspark.sql import Window

    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.groupBy("block_number").agg(F.count("*").alias(n)).repartitionByRange(parts, "block_number").withColumn("_part", F.spark_partition_id()).persist()
    totals = ordered.groupBy("_part").agg(F.sum(n).alias("_total"))
    earlier = totals.select("_part", (F.sum("_total").over(Window.orderBy("_part")) - F.col("_total")).alias("_earlier"))
    within = F.sum(n).over(Window.partitionBy("_part").orderBy("block_number")) - F.col(n)
    return ordered.withColumn("_within", within).join(F.broadcast(earlier), "_part").select("block_number", n, (F.col("_earlier") + F.col("_within")).alias("before"))


def seal_cuts(rows: DataFrame, size: int = SEAL_ROWS) -> DataFrame:
    """(first_block, last_block, rows): ranges of at least ``size`` rows that end where a block ends.

    Only counts by block are looked at. A range ends with the first block at which the running
    count passes a multiple of the size, so ranges don't depend on how rows were fetched.
    """
    part = F.floor(F.col("before") / F.lit(size)).alias("part")
    return running_counts(rows).groupBy(part).agg(F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"), F.sum("n").alias("rows")).drop("part")


def seal_ranges(rows: DataFrame, size: int, sealed: int = 0) -> DataFrame:
    """The ranges of ``seal_cuts``, counted from ``sealed`` rows before these, that later rows can't change."""
    runs = running_counts(rows).withColumn("before", F.col("before") + F.lit(sealed))
    cuts = runs.groupBy(F.floor(F.col("before") / F.lit(size)).alias("part")).agg(F.max("block_number").alias("last_block"), F.max(F.col("before") + F.col("n")).alias("after"))
    return cuts.where(F.col("after") >= (F.col("part") + 1) * size).select("last_block")


def declared_names(decoder, timestamps: bool = True) -> list[str]:
    """Columns of a decoder's table."""
    return sorted({*decoder.columns, *(c for c in IMPLICIT if timestamps or c != "block_timestamp")})

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; a batch of this many long texts still fits a Python worker.
BATCH_ROWS = 1000
#: Shuffle partitions of a table of few bytes a document that one checkpoint file may hold.
MERGED = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables below ``sf_dir``, read through Spark only (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, so that a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings of the session while what is within is planned and run."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; set only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named:
            sc.setCheckpointDir(named)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-checkpoint-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame, per_core: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again: lineage ends here.

    ``per_core`` is for tables of few bytes for each document: hundreds of tiny files cost more than
    they hold. Files are then as many as so many for each core, or one for ``MERGED`` shuffle
    partitions where that is more, so that a file's size stays bounded as partitions grow in number.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if per_core:
        df = df.coalesce(max(1, per_core * spark.sparkContext.defaultParallelism, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // MERGED)))
    return df.checkpoint(eager=True)


def hot_join(rows: DataFrame, keyed: DataFrame, key: str | list[str], n: str, spread: str, how: str = "inner", counts: DataFrame | None = None, parts: int = 64) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row for each key) without a task that meets all rows of one key.

    ``n`` is about how many of the rows hold a key, in ``counts`` (``keyed`` itself where not given),
    which should be written already. The thousand keys held most, where by more than 500 rows, are
    hot: their rows are dealt into ``parts`` by ``spread``, and their row of ``keyed`` goes to each part.
    """
    key = [key] if isinstance(key, str) else key
    hot = (keyed if counts is None else counts).where(F.col(n) > 500).orderBy(F.col(n).desc(), *key).limit(1000).select(*key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(parts))).otherwise(0).cast("int")).drop("_hot")
    each = keyed.join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return dealt.join(each, [*key, "_part"], how).drop("_part")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table holds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


#: A blank that white space follows; without any, a text can be cut at each blank.
_ODD_BLANK = re.compile(r" \s")


def chunks_of(text: str) -> tuple[str, list[str]]:
    """``text`` cut before each blank that a non-blank follows: its head, and what comes after each such blank.

    The public split pattern always starts a new match there, so chunks can be encoded
    apart and their ids concatenated. Blanks before white space stay in the chunk at hand.
    """
    parts = text.split(" ")
    if not _ODD_BLANK.search(text):
        return parts[0], parts[1:]
    out = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out[0], out[1:]


class ChunkCache:
    """Chunk (without its blank) -> little-endian unsigned 32-bit ids, for texts cut by ``chunks_of``.

    ``encode_many`` gives the ids of whole chunks. Two generations of at most about ``limit``
    entries are held: what is met again moves to the younger one, the older one is dropped.
    """

    def __init__(self, encode_many, limit: int = 250_000):
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.encode_many, self.limit = encode_many, limit

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; equal chunks are encoded once. Long lists are worked on in parts."""
        out, a = [], 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < 2_000_000):
                size, b = size + len(texts[b]), b + 1
            out += self._ids(texts[a:b])
            a = b
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        cut_up = list(map(chunks_of, texts))
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing: set[str] = set()
        for _, parts in cut_up:
            missing.update(set(parts).difference(known))
        again = [c for c in missing if c in older]
        known.update((c, older[c]) for c in again)
        missing.difference_update(again)
        new = list(missing)
        heads = list({h for h, _ in cut_up if h})
        made = self.encode_many([" " + c for c in new] + heads)
        known.update(zip(new, made))
        first = dict(zip(heads, made[len(new) :]))
        get = known.__getitem__
        return [first.get(h, b"") + b"".join(map(get, parts)) for h, parts in cut_up]


@functools.cache
def worker_cache(kind, *args):
    """One object of ``kind`` for each Python worker."""
    return kind(*args)

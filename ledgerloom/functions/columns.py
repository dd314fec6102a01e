"""Column rules of decoded ledger tables: storage kinds, exact integers, order keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ZERO_ADDRESS = "0x" + "0" * 40
#: Columns that are numbers in storage; all others are text. They are never null.
COUNTERS = ("block_number", "log_index", "_seq", "block_timestamp")
#: Columns that every event table has besides its parameters.
IMPLICIT = ("block_number", "block_hash", "block_timestamp", "tx_hash", "log_index", "address", "_seq")
#: Bands of log_index that rows without a log use.
BANDS = {"pinned_read": 500_000, "document": 625_000, "top_call": 750_000, "block": 999_999}
#: Exact arithmetic; values beyond it are null, as ``_overflow`` says.
BIG = T.DecimalType(38, 0)
#: Kinds whose values need more than 64 bits.
BIG_KINDS = ("word16", "word32")


def storage_kind(sol_type: str, indexed: bool = False) -> str:
    """The storage kind of a declared parameter type.

    An indexed value of dynamic size leaves only its hash in the log.
    """
    number = re.fullmatch(r"(u?)int(\d*)", sol_type)
    dynamic = sol_type in ("string", "bytes") or sol_type.endswith("]") or sol_type.startswith(("(", "tuple"))
    if indexed and dynamic:
        return "hash32"
    if number:
        bits = int(number[2] or 256)
        if bits <= 64:
            return "u64" if number[1] else "i64"
        return "word16" if bits <= 128 else "word32"
    if re.fullmatch(r"bytes([1-9]|[12]\d|3[0-2])", sol_type):
        return "fixed_bytes"
    return sol_type if sol_type in ("address", "bool", "string", "bytes") else "json"


def snake_case(name: str) -> str:
    """``TransferBatch`` -> ``transfer_batch``: each capital but a first one gets an underscore."""
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower() if name.isascii() else "".join(("_" if i and "A" <= c <= "Z" else "") + (c.lower() if "A" <= c <= "Z" else c) for i, c in enumerate(name))


def snake_case_column(c: Column) -> Column:
    """The same over a column."""
    return F.lower(F.regexp_replace(c, r"(?<!^)([A-Z])", "_$1"))


def sequence_key(block: Column, index: Column) -> Column:
    """Order of rows in the chain: the block's number, then 20 bits of the index."""
    return F.shiftleft(block.cast("long"), 20).bitwiseOR(index.cast("long").bitwiseAND(F.lit(0xFFFFF)))


def entity_id(block: Column, index: Column) -> Column:
    """A text id whose order is the chain's."""
    return F.format_string("%012d-%06d", block.cast("long"), index.cast("long"))


def parse_entity_id(text: str) -> tuple[int, int]:
    """(block, index) of an entity id; ValueError for anything else."""
    m = re.fullmatch(r"(\d{12,})-(\d{6,})", text)
    if not m:
        raise ValueError(f"not an entity id: {text!r}")
    return int(m[1]), int(m[2])


def big(c: Column) -> Column:
    """Decimal text (or a number) as an exact number; null where it isn't one or is too large."""
    return F.expr(f"try_cast(`{c}` AS DECIMAL(38,0))") if isinstance(c, str) else c.try_cast(BIG)


def with_big_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """For each name c: ``c_dec``, and ``c_overflow`` where c is there but has no exact number."""
    made = {}
    for n in names:
        dec = F.col(f"`{n}`").try_cast(BIG)
        made[f"{n}_dec"] = dec
        made[f"{n}_overflow"] = F.col(f"`{n}`").isNotNull() & dec.isNull()
    return df.withColumns(made)


def storage_type(name: str) -> T.DataType:
    """Physical type of a column, which its name decides."""
    return T.LongType() if name in COUNTERS else T.StringType()


def conform(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with just ``names``, in their storage types: absent ones are null, absent counters 0."""
    have = set(df.columns)
    out = []
    for n in names:
        c = F.col(f"`{n}`") if n in have else F.lit(None)
        c = c.cast(storage_type(n))
        out.append((F.coalesce(c, F.lit(0).cast("long")) if n in COUNTERS else c).alias(n))
    return df.select(*out)


def empty_table(spark, names: list[str], big_names: list[str] = ()) -> DataFrame:
    """A table without rows whose columns all bind."""
    schema = T.StructType([T.StructField(n, storage_type(n)) for n in names])
    return with_big_columns(spark.createDataFrame([], schema), list(big_names))

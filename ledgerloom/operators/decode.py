"""Decoding logs and calls into typed tables.

Which decoder a log takes is a join with the registry on (topic0, emitter), in one scan for all of
them. Parameters of fixed width are cut out of the hex text by built-in functions, numbers of 256
bits included: those beyond DECIMAL are carried through limbs of nine digits. Only events with
arrays, tuples, text or bytes are decoded value by value in Python.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import sequence_key
from ledgerloom.sources.abi import Decoder, Registry

LOG_SCHEMA = "address string, topics array<string>, data string, block_number long, block_hash string, block_timestamp long, tx_hash string, log_index long"
CHAIN = ["block_number", "block_hash", "block_timestamp", "tx_hash", "log_index"]


class DecodeError(ValueError):
    pass


def _word(data: bytes, at: int) -> bytes:
    if at < 0 or at + 32 > len(data):
        raise DecodeError("the data are too short")
    return data[at : at + 32]


def _split_tuple(inner: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(inner[at:i])
            at = i + 1
    return out + [inner[at:]] if inner else []


def parse_type(text: str):
    """("array", element, length or None) | ("tuple", elements) | ("plain", name)."""
    if text.endswith("]"):
        element, _, size = text[:-1].rpartition("[")
        return "array", parse_type(element), int(size) if size else None
    if text.startswith("("):
        return "tuple", [parse_type(t) for t in _split_tuple(text[1:-1])]
    return "plain", text


def _dynamic(t) -> bool:
    if t[0] == "plain":
        return t[1] in ("bytes", "string")
    if t[0] == "tuple":
        return any(map(_dynamic, t[1]))
    return t[2] is None or _dynamic(t[1])


def _width(t) -> int:
    """Bytes of a value of fixed size."""
    if t[0] == "plain":
        return 32
    return sum(map(_width, t[1])) if t[0] == "tuple" else _width(t[1]) * t[2]


#: Values in one array, at most: a damaged length must not ask for all memory.
_MOST_VALUES = 1 << 20


def _read(t, data: bytes, at: int):
    if t[0] == "plain":
        name = t[1]
        word = _word(data, at)
        if name in ("bytes", "string"):
            size = int.from_bytes(word, "big")
            if at + 32 + size > len(data):
                raise DecodeError("a value is longer than the data")
            body = data[at + 32 : at + 32 + size]
            return body.decode("utf-8", "replace") if name == "string" else "0x" + body.hex()
        if name == "address":
            return "0x" + word[12:].hex()
        if name == "bool":
            return word[31] != 0
        number = re.fullmatch(r"(u?)int(\d+)", name)
        if number:
            return int.from_bytes(word, "big", signed=not number[1])
        size = int(name.removeprefix("bytes") or 32) if re.fullmatch(r"bytes\d+", name) else 24 if name == "function" else 0
        if not size:
            raise DecodeError(f"unknown type {name}")
        return "0x" + word[:size].hex()
    if t[0] == "tuple":
        return _read_many(t[1], data, at)
    count, start = t[2], at
    if count is None:
        count, start = int.from_bytes(_word(data, at), "big"), at + 32
    if count > _MOST_VALUES or (count and not _dynamic(t[1]) and start + count * _width(t[1]) > len(data)):
        raise DecodeError("an array is longer than the data")
    return _read_many([t[1]] * count, data, start)


def _read_many(types: list, data: bytes, base: int) -> list:
    out, at = [], base
    for t in types:
        if _dynamic(t):
            out.append(_read(t, data, base + int.from_bytes(_word(data, at), "big")))
            at += 32
        else:
            out.append(_read(t, data, at))
            at += _width(t)
    return out


def decode_values(types: list[str], data: bytes) -> list:
    """The values of an argument block; DecodeError when it doesn't fit its types."""
    try:
        return _read_many([parse_type(t) for t in types], data, 0)
    except (OverflowError, MemoryError, RecursionError) as e:
        raise DecodeError(str(e)) from e


def _json_safe(v):
    if isinstance(v, list):
        return [_json_safe(x) for x in v]
    return str(v) if isinstance(v, int) and not isinstance(v, bool) else v


def as_text(kind: str, v) -> str:
    """A value as stored: numbers in decimal, bools as words, nested values as JSON with numbers as text."""
    if kind == "u64":
        return str(min(v, 2**64 - 1))
    if kind == "i64":
        return str(max(-(2**63), min(v, 2**63 - 1)))
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(_json_safe(v), ensure_ascii=False) if isinstance(v, list) else str(v)


def decode_log(decoder: Decoder, topics: list[str], data: str) -> dict[str, str]:
    """Column -> text of one log. Indexed parameters come from topics, the others from data."""
    indexed = [p for p in decoder.params if p.indexed]
    if len(topics) != len(indexed) + 1:
        raise DecodeError("the number of topics doesn't fit")
    plain = [p for p in decoder.params if not p.indexed]
    out = dict(zip((p.column for p in plain), (as_text(p.kind, v) for p, v in zip(plain, decode_values([p.sol_type for p in plain], bytes.fromhex(data[2:]))))))
    for p, topic in zip(indexed, topics[1:]):
        out[p.column] = topic.lower() if p.kind == "hash32" else as_text(p.kind, decode_values([p.sol_type], bytes.fromhex(topic[2:]))[0])
    return {p.column: out[p.column] for p in decoder.params}


def decode_call(decoder: Decoder, data: str) -> dict[str, str]:
    """Column -> text of a call's arguments."""
    values = decode_values([p.sol_type for p in decoder.params], bytes.fromhex(data[10:]))
    return {p.column: as_text(p.kind, v) for p, v in zip(decoder.params, values)}


def _topic0() -> Column:
    """The first topic; null for a log without topics, which anonymous events may leave."""
    return F.lower(F.get("topics", F.lit(0)))


def _with_chain(df: DataFrame, decoder: Decoder, extra: list[str]) -> DataFrame:
    return df.select(*CHAIN, F.lower("address").alias("address"), sequence_key(F.col("block_number"), F.col("log_index")).alias("_seq"), F.lit(decoder.table).alias("table"), *(F.col(f"`{c}`") for c in extra))


_NUMBER = re.compile(r"(u?)int\d+")


def _fixed_only(decoder: Decoder) -> bool:
    return all(p.kind in ("address", "bool", "fixed_bytes", "hash32") or _NUMBER.fullmatch(p.sol_type) for p in decoder.params)


def _limbs(raw: Column, negative: Column) -> Column:
    """The decimal digits of a 256-bit word of any size: its limbs of 32 bits carried through limbs of nine digits."""
    inverse = F.translate(raw, "0123456789abcdef", "fedcba9876543210")
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(F.when(negative, inverse).otherwise(raw), i * 8 + 1, F.lit(8)), 16, 10).cast("long") + F.when(negative & (i == 7), 1).otherwise(0))
    base, nines = F.lit(1 << 32).cast("long"), F.lit(10**9).cast("long")
    none = F.array().cast("array<bigint>")

    def carry(digits: Column, limb: Column) -> Column:
        def step(a: Column, d: Column) -> Column:
            total = d * base + a["c"]
            return F.struct(F.call_function("div", total, nines).alias("c"), F.concat(a["o"], F.array(total % nines)).alias("o"))

        return F.aggregate(digits, F.struct(limb.alias("c"), none.alias("o")), step, lambda a: a["o"])

    digits = F.aggregate(limbs, F.array(*[F.lit(0).cast("long")] * 9), carry)
    text = F.array_join(F.transform(F.reverse(digits), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    return F.concat(F.when(negative, "-").otherwise(""), F.regexp_replace(text, "^0+(?!$)", ""))


def number_text(raw: Column, signed: bool) -> Column:
    """A 256-bit word (64 lower-case hex digits) in decimal: in 64 bits or DECIMAL where it fits, else by limbs."""
    low = F.substring(raw, 49, 16)
    small = F.when(F.substring(raw, 1, 48) == "0" * 48, F.conv(low, 16, 10))
    if signed:
        small = small.when((F.substring(raw, 1, 48) == "f" * 48) & (low >= "8"), F.conv(low, 16, -10))
    high = F.conv(F.substring(raw, 33, 16), 16, 10).cast("decimal(20,0)")
    # Below 2 ** 124 both halves and their sum are exact in 38 digits.
    middle = (high * F.lit(str(2**64)).cast("decimal(20,0)") + F.conv(low, 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    small = small.when(F.substring(raw, 1, 33) == "0" * 33, middle)
    return small.otherwise(_limbs(raw, F.substring(raw, 1, 1) >= "8" if signed else F.lit(False)))


def _builtin(decoder: Decoder, logs: DataFrame) -> DataFrame:
    """Decoding by cutting words out of hex text; logs that don't fit are left out."""
    words, columns, topic, word = {}, {}, 1, 0
    for p in decoder.params:
        if p.indexed:
            raw = F.lower(F.substring(F.get("topics", F.lit(topic)), 3, 64))
            topic += 1
        else:
            raw = F.lower(F.substring("data", 3 + 64 * word, 64))
            word += 1
        # A projection of its own: a word is cut out once, however often its value's cases look at it.
        words[f"_w{len(words)}"], raw = raw, F.col(f"_w{len(words)}")
        if p.kind == "address":
            value = F.concat(F.lit("0x"), F.substring(raw, 25, 40))
        elif p.kind == "bool":
            value = F.when(F.substring(raw, 63, 2) == "00", "false").otherwise("true")
        elif p.kind == "u64":
            value = F.when(F.substring(raw, 1, 48) == "0" * 48, F.conv(F.substring(raw, 49, 16), 16, 10)).otherwise(str(2**64 - 1))
        elif p.kind == "i64":
            low, above = F.substring(raw, 49, 16), F.substring(raw, 1, 48)
            within = ((above == "0" * 48) & (low < "8")) | ((above == "f" * 48) & (low >= "8"))
            value = F.when(within, F.conv(low, 16, -10)).when(raw >= "8", str(-(2**63))).otherwise(str(2**63 - 1))
        elif number := _NUMBER.fullmatch(p.sol_type):
            value = number_text(raw, not number[1])
        elif p.kind == "hash32":
            value = F.concat(F.lit("0x"), raw)
        else:
            value = F.concat(F.lit("0x"), F.substring(raw, 1, 2 * int(p.sol_type.removeprefix("bytes"))))
        columns[p.column] = value
    fits = (F.size("topics") == topic) & (F.length("data") >= 2 + 64 * word)
    if any(_NUMBER.fullmatch(p.sol_type) for p in decoder.params):  # what isn't hexadecimal isn't a number
        fits &= F.concat(F.substring("data", 3, 64 * word), *(F.substring(F.get("topics", F.lit(k)), 3, 64) for k in range(1, topic))).rlike("^[0-9a-fA-F]*$")
    return _with_chain(logs.where(fits).withColumns(words).withColumns(columns), decoder, decoder.columns)


def _batched(decoder: Decoder, rows: DataFrame, one) -> DataFrame:
    """Decoding in batches; rows that can't be decoded are left out."""
    columns = decoder.columns
    chain = [*CHAIN, "address"]
    schema = "block_number long, block_hash string, block_timestamp long, tx_hash string, log_index long, address string, " + ", ".join(f"`{c}` string" for c in columns)

    def run(frames):
        for f in frames:
            keep, out = [], []
            for k, (topics, data) in enumerate(zip(f["topics"], f["data"])):
                try:
                    out.append(one(decoder, topics, data))
                    keep.append(k)
                except ValueError:
                    continue
            left = f.iloc[keep][chain].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame(out, columns=columns, dtype="object", index=range(len(out)))], axis=1)

    return _with_chain(rows.select(*CHAIN, "address", "topics", "data").mapInPandas(run, schema), decoder, columns)


def _decode(decoder: Decoder, logs: DataFrame) -> DataFrame:
    if _fixed_only(decoder):
        return _builtin(decoder, logs)
    return _batched(decoder, logs, lambda d, topics, data: decode_log(d, list(topics), data))


def route(registry: Registry, logs: DataFrame) -> DataFrame:
    """``logs`` that a contract of the registry declares, with ``_table``: one scan, whatever the number of events.

    The registry is a file that people write, so it is small enough for every executor.
    """
    known = [(d.selector, d.address, d.table) for d in registry.decoders if d.kind == "event" and d.address]
    places = logs.sparkSession.createDataFrame(known, "_topic string, _emitter string, _table string")
    found = logs.withColumns({"_topic": _topic0(), "_emitter": F.lower("address")})
    return found.join(F.broadcast(places), ["_topic", "_emitter"]).drop("_topic", "_emitter")


def decode_events(registry: Registry, logs: DataFrame) -> dict[str, DataFrame]:
    """table -> rows of the logs that contracts of the registry emitted. Logs nobody declares are left out.

    With several events, what ``route`` finds is kept, so that the logs are scanned once and each
    table reads its own rows; drop it with ``spark.catalog.clearCache`` or at the session's end.
    """
    events = [d for d in registry.decoders if d.kind == "event" and d.address]
    if len(events) == 1:
        d = events[0]
        return {d.table: _decode(d, logs.where((_topic0() == d.selector) & (F.lower("address") == d.address)))}
    routed = route(registry, logs).persist() if events else logs
    return {d.table: _decode(d, routed.where(F.col("_table") == d.table)) for d in events}


def decode_children(registry: Registry, logs: DataFrame, children: DataFrame, template: str) -> dict[str, DataFrame]:
    """table -> rows of the logs that a template's children emitted after their discovery."""
    from ledgerloom.operators.joins import after_discovery

    mine = after_discovery(logs, children.where(F.col("template") == template)).drop("template")
    return {d.table: _decode(d, mine.where(_topic0() == d.selector)) for d in registry.decoders if d.kind == "event" and d.address is None and d.alias == template}


def _call_fits(decoder: Decoder) -> Column:
    """Whether a call's data hold all of the decoder's words."""
    return (F.length("data") >= 10 + 64 * len(decoder.params)) & (F.length("data") % 2 == 0) & F.col("data").rlike("^0x[0-9a-f]*$")


def _call_decodes(decoder: Decoder):
    """The same for arguments without fixed places, which only decoding tells."""

    @F.pandas_udf("boolean")
    def fits(data: pd.Series) -> pd.Series:
        def one(x) -> bool:
            try:
                return bool(decode_call(decoder, x)) or True
            except ValueError:
                return False

        return data.map(one)

    return fits


def decode_calls(registry: Registry, calls: DataFrame) -> dict[str, DataFrame]:
    """table -> rows of top-level calls (address, input and the chain's columns), and ``calls_raw`` for those of declared contracts that no decoder fits."""
    functions = [d for d in registry.decoders if d.kind == "function" and d.address]
    scope = sorted({d.address for d in functions})
    mine = calls.where(F.lower("address").isin(scope) & (F.length("input") >= 10)).withColumns({"topics": F.array().cast("array<string>"), "data": F.lower("input")})
    out, raw = {}, mine
    for d in functions:
        own = (F.substring("data", 1, 10) == d.selector) & (F.lower("address") == d.address)
        out[d.table] = _batched(d, mine.where(own), lambda d, _, data: decode_call(d, data))
    # A decoder fails on calls of its own alone, so only these are looked at a second time, by their shape.
    fits = F.lit(False)
    for d in functions:
        own = (F.substring("data", 1, 10) == d.selector) & (F.lower("address") == d.address)
        fits |= own & (_call_fits(d) if _fixed_only(d) else _call_decodes(d)(F.col("data")))
    raw = raw.where(~fits)
    out["calls_raw"] = raw.select(*CHAIN, F.lower("address").alias("address"), sequence_key(F.col("block_number"), F.col("log_index")).alias("_seq"), F.lit("calls_raw").alias("table"), F.substring("data", 1, 10).alias("selector"), F.col("data").alias("input"))
    return out


def block_rows(headers: DataFrame) -> DataFrame:
    """One ``blocks`` row for each header, at the index that is kept for it."""
    from ledgerloom.functions.columns import BANDS

    own = ["parent_hash", "miner", "gas_used", "gas_limit", "base_fee_per_gas", "size", "transaction_count"]
    index = F.lit(BANDS["block"]).cast("long")
    return headers.select("block_number", "block_hash", "block_timestamp", index.alias("log_index"), sequence_key(F.col("block_number"), index).alias("_seq"), F.lit("blocks").alias("table"), *(F.col(c).cast("string").alias(c) for c in own))


def log_filter(logs: DataFrame, addresses: list[str], topics: list[str]) -> DataFrame:
    """Logs of any of the addresses with any of the first topics; a filter without either is refused."""
    if not addresses and not topics:
        raise ValueError("the filter is empty")
    if addresses:
        logs = logs.where(F.lower("address").isin([a.lower() for a in addresses]))
    return logs.where(_topic0().isin([t.lower() for t in topics])) if topics else logs

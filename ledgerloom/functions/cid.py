"""Content identifiers: version 0 and 1, and checking content against them."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
RAW, DAG_PB, SHA2_256 = 0x55, 0x70, 0x12


@dataclass(frozen=True)
class Cid:
    version: int
    codec: int
    hash_kind: int
    digest: bytes


def _base58(text: str) -> bytes:
    n = 0
    for c in text:
        if c not in _BASE58:
            raise ValueError("not base58")
        n = n * 58 + _BASE58.index(c)
    zeros = len(text) - len(text.lstrip("1"))
    return bytes(zeros) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut short")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def parse_cid(text: str) -> Cid:
    """A CID from text, with or without ``ipfs://`` and a path; ValueError otherwise."""
    text = text.strip().removeprefix("ipfs://").removeprefix("ipfs/").split("/")[0]
    if text.startswith("Qm") and len(text) == 46:
        raw = _base58(text)
        if len(raw) != 34 or raw[:2] != bytes([SHA2_256, 32]):
            raise ValueError("not a version 0 CID")
        return Cid(0, DAG_PB, SHA2_256, raw[2:])
    if not text:
        raise ValueError("no CID")
    if text[0] in "bB":
        body = text[1:].upper()
        raw = base64.b32decode(body + "=" * (-len(body) % 8))
    elif text[0] == "z":
        raw = _base58(text[1:])
    elif text[0] == "f":
        raw = bytes.fromhex(text[1:])
    else:
        raise ValueError("unknown base")
    version, at = _varint(raw, 0)
    codec, at = _varint(raw, at)
    kind, at = _varint(raw, at)
    size, at = _varint(raw, at)
    if version != 1 or len(raw) - at != size:
        raise ValueError("not a version 1 CID")
    return Cid(1, codec, kind, raw[at:])


def _field(number: int, kind: int) -> bytes:
    return bytes([number << 3 | kind])


def _as_varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def verify(cid: Cid, content: bytes) -> bool:
    """Whether content that fits one block has this CID: raw, or a file node around it."""
    if cid.hash_kind != SHA2_256:
        return False
    if cid.codec == RAW:
        return hashlib.sha256(content).digest() == cid.digest
    if cid.codec != DAG_PB:
        return False
    unix = _field(1, 0) + _as_varint(2) + (_field(2, 2) + _as_varint(len(content)) + content if content else b"") + _field(3, 0) + _as_varint(len(content))
    node = _field(1, 2) + _as_varint(len(unix)) + unix
    return hashlib.sha256(node).digest() == cid.digest


def verified_documents(spark, rows, cid: str = "cid", content: str = "content"):
    """``rows`` with ``verified``; a document that isn't there yet has null, as has a CID that can't be read."""
    import pandas as pd
    from pyspark.sql import functions as F

    def check(cids: pd.Series, bodies: pd.Series) -> pd.Series:
        def one(c, b):
            if c is None or b is None:
                return None
            try:
                return verify(parse_cid(c), bytes(b))
            except ValueError:
                return None

        return pd.Series([one(c, b) for c, b in zip(cids, bodies)], dtype="object")

    return rows.withColumn("verified", F.pandas_udf(check, "boolean")(F.col(cid), F.col(content).cast("binary")))

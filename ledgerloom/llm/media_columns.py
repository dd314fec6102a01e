"""Baseline JPEG columns: marker parsing, Huffman decoding and DC-only thumbnails in numpy.

Restart segments are independent, so the decoder walks the segments of many images in step:
one table lookup reads a code from every segment at once. ``store_payloads`` writes bytes as
quantised coefficients. A Huffman table with the one symbol "size 8" makes each coefficient a
0 bit and eight magnitude bits, which are the byte itself, so any byte is stored without loss.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import _common as C

BLOCK = 64


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    components: list = field(default_factory=list)  # (id, h, v, quantisation table)
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id) -> (16 counts, symbols)
    restart: int = 0
    scan: list = field(default_factory=list)  # (component index, DC table, AC table)
    comment: bytes = b""
    body: tuple = (0, 0)


def parse_markers(data: bytes) -> Frame:
    """Headers of a baseline JPEG; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    frame, at = Frame(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        part = data[at + 4 : at + 2 + size]
        if size < 2 or len(part) != size - 2:
            raise ValueError("a segment is cut short")
        at += 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(part):
                wide = part[k] >> 4
                frame.quant[part[k] & 15] = np.frombuffer(part, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif kind == 0xC0:
            bits, frame.height, frame.width, n = struct.unpack_from(">BHHB", part)
            if bits != 8 or not frame.width or not frame.height:
                raise ValueError("not an 8-bit image of known size")
            frame.components = [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xC4:
            k = 0
            while k < len(part):
                counts = part[k + 1 : k + 17]
                frame.tables[part[k] >> 4, part[k] & 15] = (counts, part[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif kind == 0xDD:
            frame.restart = struct.unpack(">H", part)[0]
        elif kind == 0xFE:
            frame.comment = part
        elif kind == 0xDA:
            ids = {c[0]: i for i, c in enumerate(frame.components)}
            frame.scan = [(ids[part[1 + 2 * i]], part[2 + 2 * i] >> 4, part[2 + 2 * i] & 15) for i in range(part[0])]
            if len(frame.scan) != len(frame.components):
                raise ValueError("the scan doesn't hold every component")
            end = data.rfind(b"\xff\xd9")
            if end < at:
                raise ValueError("no EOI marker")
            frame.body = (at, end)
            return frame


def code_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: code length << 8 | symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.uint16), 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """The unstuffed bytes of many segments, read at a bit position of each."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        self.window = np.zeros(len(data) + 1, np.uint64)
        for k in range(8):
            self.window |= padded[k : k + len(data) + 1] << np.uint64(56 - 8 * k)
        self.last = 8 * len(data)

    def read(self, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, their magnitudes' values, new positions, and whether a code was there."""
        word = self.window[np.minimum(at, self.last) >> 3] << (at & 7).astype(np.uint64)
        entry = table[(word >> np.uint64(48)).astype(np.int64)]
        length, symbol = (entry >> 8).astype(np.int64), (entry & 255).astype(np.int64)
        size = symbol & 15
        raw = ((word << length.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
        return symbol, value, at + length + size, length > 0


def _segments(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unstuffed bytes, and the segments' starts in them (with the end)."""
    full = np.flatnonzero(body[:-1] == 0xFF) if len(body) else np.zeros(0, np.int64)
    nxt = body[full + 1]
    drop = np.zeros(len(body), bool)
    drop[full[nxt == 0] + 1] = True
    rst = full[(nxt >= 0xD0) & (nxt <= 0xD7)]
    drop[rst] = drop[rst + 1] = True
    kept = ~drop
    before = np.concatenate([[0], np.cumsum(kept)])
    return body[kept], np.concatenate([[0], before[rst], before[-1:]])


def decode_coefficients(images: list[bytes], frames: list[Frame]) -> list[dict[int, np.ndarray]]:
    """For each image: component -> (rows, columns, 64) coefficients in zigzag order.

    Images with the same tables and sampling are decoded in step. A damaged stream raises.
    """
    groups: dict = {}
    for k, f in enumerate(frames):
        key = (tuple(sorted(f.tables.items())), tuple(c[1:3] for c in f.components), tuple(f.scan))
        groups.setdefault(key, []).append(k)
    out: list = [None] * len(images)
    for members in groups.values():
        _decode_group([images[k] for k in members], [frames[k] for k in members], members, out)
    return out


def _decode_group(images, frames, members, out) -> None:
    like = frames[0]
    tables = {k: code_table(*v) for k, v in like.tables.items()}
    single = len(like.components) == 1
    h_max, v_max = (1, 1) if single else (max(c[1] for c in like.components), max(c[2] for c in like.components))
    plan = []  # of an MCU: (component, DC table, AC table, row in the MCU, column)
    for i, dc, ac in like.scan:
        h, v = (1, 1) if single else like.components[i][1:3]
        plan += [(i, tables[0, dc], tables[1, ac], y, x) for y in range(v) for x in range(h)]
    bodies, starts, mcu_first, mcu_count, owner, grid, offset = [], [], [], [], [], [], 0
    for n, (data, f) in enumerate(zip(images, frames)):
        wide, high = -(-f.width // (8 * h_max)), -(-f.height // (8 * v_max))
        grid.append((wide, high))
        body, cuts = _segments(np.frombuffer(data, np.uint8, f.body[1] - f.body[0], f.body[0]))
        each = f.restart or wide * high
        first = np.arange(0, wide * high, each)
        if len(first) != len(cuts) - 1:
            raise ValueError("restart markers don't fit the size")
        bodies.append(body)
        starts.append(cuts[:-1] + offset)
        mcu_first.append(first)
        mcu_count.append(np.minimum(each, wide * high - first))
        owner.append(np.full(len(first), n))
        offset += len(body)
    bits = _Bits(np.concatenate(bodies))
    at = np.concatenate(starts).astype(np.int64) * 8
    mcu_first, mcu_count, owner = map(np.concatenate, (mcu_first, mcu_count, owner))
    mcus = np.array([w * h for w, h in grid])
    base = np.concatenate([[0], np.cumsum(mcus)])
    place = base[owner] + mcu_first
    store = np.zeros((len(plan), base[-1], 64), np.int16)
    before = np.zeros((len(like.components), len(at)), np.int64)
    for step in range(int(mcu_count.max())):
        row = np.flatnonzero(mcu_count > step)
        for b, (i, dc, ac, _, _) in enumerate(plan):
            _, diff, at[row], good = bits.read(at[row], dc)
            if not good.all():
                raise ValueError("no such code")
            before[i, row] += diff
            block = store[b]
            target = place[row] + step
            block[target, 0] = before[i, row]
            live, k, pos = np.arange(len(row)), np.ones(len(row), np.int64), at[row]
            while len(live):
                symbol, value, pos_new, good = bits.read(pos[live], ac)
                if not good.all():
                    raise ValueError("no such code")
                pos[live] = pos_new
                run, size = symbol >> 4, symbol & 15
                k[live] += np.where(size > 0, run, np.where(run == 15, 16, 64))
                hit = size > 0
                if (k[live[hit]] > 63).any():
                    raise ValueError("a run leaves the block")
                block[target[live[hit]], k[live[hit]]] = value[hit]
                k[live[hit]] += 1
                live = live[k[live] < 64]
            at[row] = pos
    for n, (wide, high) in enumerate(grid):
        parts = {}
        for i, (_, h, v, _) in enumerate(like.components):
            h, v = (1, 1) if single else (h, v)
            full = np.zeros((high, v, wide, h, 64), np.int16)
            for b, (j, _, _, y, x) in enumerate(plan):
                if j == i:
                    full[:, y, :, x] = store[b, base[n] : base[n + 1]].reshape(high, wide, 64)
            parts[i] = full.reshape(high * v, wide * h, 64)
        out[members[n]] = parts


def thumbnail(frame: Frame, luminance: np.ndarray) -> np.ndarray:
    """One pixel for each 8 x 8 block, from its DC coefficient alone."""
    h = max(c[1] for c in frame.components) if len(frame.components) > 1 else 1
    v = max(c[2] for c in frame.components) if len(frame.components) > 1 else 1
    _, ch, cv, q = frame.components[0]
    ch, cv = (ch, cv) if len(frame.components) > 1 else (1, 1)
    rows, columns = -(-frame.height * cv // (8 * v)), -(-frame.width * ch // (8 * h))
    dc = luminance[:rows, :columns, 0].astype(np.int64) * frame.quant[q][0]
    return np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid of sums are brighter than the mean of all."""
    high, wide = pixels.shape
    ys, xs = (np.arange(9) * high) // 8, (np.arange(9) * wide) // 8
    y1, x1 = np.maximum(ys[1:], ys[:-1] + 1), np.maximum(xs[1:], xs[:-1] + 1)
    total = np.zeros((high + 1, wide + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    y0, x0 = np.minimum(ys[:-1], high - 1), np.minimum(xs[:-1], wide - 1)
    y1, x1 = np.minimum(np.maximum(y1, y0 + 1), high), np.minimum(np.maximum(x1, x0 + 1), wide)
    cell = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    bright = cell * (high * wide) > total[-1, -1] * ((y1 - y0)[:, None] * (x1 - x0))
    return np.packbits(bright).tobytes().hex()


def _chunk(kind: int, part: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(part) + 2) + part


_ONE_CODE = bytes([1] + [0] * 15)
_HEAD = b"\xff\xd8" + _chunk(0xDB, bytes([0] + [1] * 64))
_TABLES = _chunk(0xC4, b"\x00" + _ONE_CODE + b"\x08") + _chunk(0xC4, b"\x10" + _ONE_CODE + b"\x08") + _chunk(0xDD, b"\x00\x01")
_SCAN = _chunk(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def store_payloads(payloads: list[bytes]) -> list[bytes]:
    """A grey baseline JPEG for each payload (its length a positive multiple of 64).

    Each byte is a coefficient of size 8, each 64 bytes are a block, each block is its own
    restart segment. The comment holds the payload's length.
    """
    sizes = [len(p) // BLOCK for p in payloads]
    wide = [min(8191, max(int(np.ceil(np.sqrt(n))), -(-n // 8191))) for n in sizes]
    high = [-(-n // w) for n, w in zip(sizes, wide)]
    data = np.frombuffer(b"".join(p + bytes(BLOCK * (w * h - n)) for p, n, w, h in zip(payloads, sizes, wide, high)), np.uint8)
    blocks = data.reshape(-1, BLOCK)
    ends = np.cumsum([w * h for w, h in zip(wide, high)])
    number = np.arange(len(blocks)) - np.repeat(ends - np.diff(ends, prepend=0), np.diff(ends, prepend=0))
    stream = np.empty((len(blocks), 74), np.uint8)
    for a in range(0, len(blocks), 1 << 15):
        part = blocks[a : a + (1 << 15)]
        bit = np.zeros((len(part), BLOCK, 9), np.uint8)
        bit[:, :, 1:] = np.unpackbits(part, axis=1).reshape(len(part), BLOCK, 8)
        stream[a : a + len(part), :72] = np.packbits(bit.reshape(len(part), -1), axis=1)
    stream[:, 72], stream[:, 73] = 0xFF, 0xD0 + number % 8
    stuffed = stream[:, :72] == 0xFF
    width = np.ones(stream.shape, np.int64)
    width[:, :72] += stuffed
    place = np.cumsum(width.ravel())
    body = np.zeros(place[-1] if len(place) else 0, np.uint8)
    body[place - width.ravel()] = stream.ravel()
    cuts = np.concatenate([[0], place[ends * 74 - 1]])
    return [
        _HEAD + _chunk(0xFE, struct.pack(">Q", len(p))) + _chunk(0xC0, struct.pack(">BHHB", 8, 8 * h, 8 * w, 1) + bytes([1, 0x11, 0])) + _TABLES + _SCAN + body[a : b - 2].tobytes() + b"\xff\xd9"
        for p, w, h, a, b in zip(payloads, wide, high, cuts[:-1], cuts[1:])
    ]


def read_payloads(images: list[bytes]) -> tuple[list[Frame], list[bytes], list[np.ndarray]]:
    """Headers, payloads and thumbnails of what ``store_payloads`` wrote."""
    frames = list(map(parse_markers, images))
    coefficients = decode_coefficients(images, frames)
    payloads = []
    for f, parts in zip(frames, coefficients):
        v = parts[0].reshape(-1)[: struct.unpack(">Q", f.comment)[0]]
        payloads.append(np.where(v < 0, v + 255, v).astype(np.uint8).tobytes())
    return frames, payloads, [thumbnail(f, parts[0]) for f, parts in zip(frames, coefficients)]


def jpeg_thumbnails(images: DataFrame) -> DataFrame:
    """(media_id, width, height, thumb_width, thumb_height, thumb, thumb_hash, error) of ``images`` (media_id, data).

    Bytes that are null, empty, damaged or no baseline JPEG give null values and the reason in ``error``.
    """
    C.small_batches(images.sparkSession)
    schema = "media_id long, width int, height int, thumb_width int, thumb_height int, thumb binary, thumb_hash string, error string"

    def one(data: bytes | None):
        try:
            f = parse_markers(data or b"")
            pixels = thumbnail(f, decode_coefficients([data], [f])[0][0])
        except (ValueError, KeyError, IndexError, struct.error) as e:
            return (None,) * 6 + (f"{type(e).__name__}: {e}",)
        return f.width, f.height, pixels.shape[1], pixels.shape[0], pixels.tobytes(), thumbnail_hash(pixels), None

    kinds = (pa.int32(),) * 4 + (pa.binary(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in batch.column("data").to_pylist()]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("media_id"), *columns], names=[x.split()[0] for x in schema.split(", ")])

    return C.pick(images, "media_id", "data").mapInArrow(run, schema)


def store_texts(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each text of ``docs`` (doc_id, text) as a JPEG column, read back and described.

    The payload is the text's UTF-8 bytes and zero bytes up to a positive multiple of 64; a
    null text is an empty one. Equal texts give equal values; other columns are ignored.
    """
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int" + ", media binary" * keep_media

    def run(batches):
        for batch in batches:
            texts = C.text_bytes(batch.column("text"))
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) <= 8_000_000):
                    size, b = size + len(texts[b]), b + 1
                part = texts[a:b]
                media = store_payloads([t + bytes(-len(t) % BLOCK or BLOCK * (not t)) for t in part])
                frames, payloads, thumbs = read_payloads(media)
                columns = [
                    batch.column("doc_id").slice(a, b - a), pa.array(map(len, part), pa.int64()), pa.array(map(len, payloads), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()),
                    pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                    pa.array([f"{f.width}x{f.height}:{thumbnail_hash(t)}" for f, t in zip(frames, thumbs)]),
                    pa.array([f.width for f in frames], pa.int32()), pa.array([f.height for f in frames], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(media, pa.binary())] * keep_media, names=[x.split()[0] for x in schema.split(", ")])
                a = b

    return C.pick(docs, "doc_id", "text").mapInArrow(run, schema)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` stored as a JPEG and read back; see ``store_texts``."""
    return store_texts(C.table(spark, sf_dir, "documents"), keep_media=False)

"""Best-fit packing by a configuration linear program over the length histogram.

The program has a variable for each multiset of lengths that fits a sequence. It is solved by
multiplicative weights: lengths that are covered least weigh most, and a knapsack dynamic
program prices the next multiset. The solution is rounded down, never beyond what is there,
and best fit places the remainder, on the histogram as well: the work on the driver depends
on the capacity, not on the number of documents.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C
from ledgerloom.llm.byte_bpe import ByteBPE

#: Rounds of multiplicative weights and their step.
ROUNDS, STEP = 150, 0.25
#: Shares of the fractional solution that are rounded; the one with the fewest sequences counts.
ROUND_PARTS = (1.0, 0.9, 0.7, 0.4)
#: Pieces that one group of the ranking holds.
RANK_ROWS = 2000


def price(lengths: np.ndarray, weight: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths (index -> count) of most weight that fits: an unbounded knapsack."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fits[c]
        if k:
            value = best[c - lengths[:k]] + weight[:k]
            top = int(value.argmax())
            if value[top] > best[c - 1]:
                best[c], pick[c] = value[top], top
                continue
        best[c] = best[c - 1]
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[int(pick[c])] = out.get(int(pick[c]), 0) + 1
            c -= int(lengths[pick[c]])
    return out


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> tuple[list, np.ndarray]:
    """Multisets and how often each is used, so that demands are about covered."""
    covered = np.zeros(len(lengths))
    found: dict[tuple, float] = {}
    whole = float((lengths * demand).sum()) / capacity
    for _ in range(rounds):
        weight = np.exp(-(covered - covered.min()) * len(lengths) * step / max(1.0, np.log(len(lengths) + 1))) / demand
        weight = weight / weight.max() + 1e-9 * lengths / capacity
        chosen = price(lengths, weight, capacity)
        index = np.fromiter(chosen, np.int64)
        count = np.fromiter(chosen.values(), np.float64)
        amount = min(float((demand[index] / count).min()), whole)
        covered[index] += amount * count / demand[index]
        key = tuple(sorted(chosen.items()))
        found[key] = found.get(key, 0.0) + amount
    use = np.array(list(found.values()))
    over = np.zeros(len(lengths))
    for key, x in zip(found, use):
        for i, a in key:
            over[i] += a * x / demand[i]
    # No length is used more often than it is there: each multiset gives way to its most overused length.
    scale = np.array([1 / max(1.0, max(over[i] for i, _ in key)) for key in found])
    return list(found), use * scale


def plan_bins(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, count)]) that hold every piece of the histogram exactly once."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    out = []
    if capacity in left:
        out.append((left.pop(capacity), [(capacity, 1)]))
    if not left:
        return out
    lengths = np.array(sorted(left), np.int64)
    demand = np.array([left[int(x)] for x in lengths], np.int64)
    keys, use = fractional(lengths, demand.astype(float), capacity, rounds)
    tries = [_rounded(lengths, demand, keys, use * part, capacity) for part in ROUND_PARTS]
    return out + min(tries, key=lambda bins: sum(times for times, _ in bins))


def _rounded(lengths: np.ndarray, demand: np.ndarray, keys: list, use: np.ndarray, capacity: int) -> list:
    """The solution rounded down, never beyond what is there, and best fit for the rest."""
    out, remaining = [], demand.copy()
    full = [k for k, key in enumerate(keys) if sum(int(lengths[i]) * a for i, a in key) == capacity]
    for k in sorted(full, key=lambda k: -use[k]):
        times = min([int(use[k]), *(int(remaining[i]) // a for i, a in keys[k])])
        if times > 0:
            out.append((times, [(int(lengths[i]), a) for i, a in keys[k]]))
            for i, a in keys[k]:
                remaining[i] -= a * times
    return out + best_fit({int(x): int(n) for x, n in zip(lengths, remaining) if n}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest first, each into the fullest sequence that takes it; like sequences move as one."""
    open_bins: dict[int, list] = {}  # free room -> [(sequences, items)]
    room = np.zeros(capacity + 1, bool)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            tight = np.flatnonzero(room[length:])
            if len(tight):
                free = int(tight[0]) + length
                times, items = open_bins[free].pop()
                room[free] = bool(open_bins[free])
            else:
                free, items = capacity, []
                times = -(-n // (capacity // length))
            each = free // length
            full = min(times, n // each)
            parts = [(full, each)] if full else []
            n -= full * each
            if full < times and n and n < each:
                parts.append((1, n))
                n = 0
            used = sum(p[0] for p in parts)
            for count, k in parts:
                open_bins.setdefault(free - k * length, []).append((count, [*items, (length, k)]))
                room[free - k * length] = True
            if used < times and items:
                open_bins.setdefault(free, []).append((times - used, items))
                room[free] = True
    return [x for group in open_bins.values() for x in group]


class _Tokenizer:
    """Ids of whole texts by a JSON vocabulary: its merges in order, run by a compiled library.

    What the library gives up on is encoded by the matrices of ``byte_bpe``. With ``added`` the
    JSON's added tokens are found in texts, as the ``tokenizers`` library does at its defaults.
    """

    def __init__(self, path: str, added: bool = False):
        import public_tokenizers
        import tiktoken

        self.own = ByteBPE.from_json(path, public_tokenizers.PATTERN)
        self.fast = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.own.vocab, special_tokens=self._added(path) if added else {})
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.fast._special_tokens, key=len, reverse=True)))) if self.fast._special_tokens else None

    @staticmethod
    def _added(path: str) -> dict[str, int]:
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take blanks or whole words only aren't known here")
        return {t["content"]: t["id"] for t in tokens}

    def ids(self, text: str) -> bytes:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
        except Exception:  # noqa: BLE001  its pattern engine has limits of its own
            return self._slow(text)

    def _slow(self, text: str) -> bytes:
        cache, at, out = C.ChunkCache(self.own.encode_chunks), 0, []
        for m in self.cuts.finditer(text) if self.cuts else ():
            out += [*cache.ids([text[at : m.start()]]), np.array([self.fast._special_tokens[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, *cache.ids([text[at:]])])


def cut_documents(docs: DataFrame, path: str, capacity: int, end_id: int, keep_ids: bool = False, added: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): token ids and ``end_id``, cut into pieces that fit.

    A null text has ``end_id`` alone. Only documents longer than ``capacity`` are cut, and only
    their first piece may be shorter.
    """
    C.small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        tokenizer = C.worker_cache(_Tokenizer, path, added)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = tokenizer.ids(text or "") + end
                total = len(ids) // 4
                first = total % capacity or capacity
                cuts = [0, *range(first, total + 1, capacity)] if total > capacity else [0, total]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part)[: 5 + keep_ids])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5 + keep_ids)], names=[x.split()[0] for x in schema.split(", ")])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, schema)


def place_pieces(pieces: DataFrame, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no gaps, nothing beyond ``capacity``.

    Pieces of a length are interchangeable. Each gets a rank among them, from its rank in a
    small salted group and the counts of the groups before; the plan says where that rank goes.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity, rounds)
    slots: dict[int, list] = {}
    base = 0
    for times, items in plan:
        offset = 0
        for length, each in items:
            held = slots.setdefault(length, [])
            held.append((held[-1][0] + held[-1][5] if held else 0, each, base, offset, length, times * each))
            offset += length * each
        base += times
    table = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})

    groups = max(1, sum(histogram.values()) // RANK_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local", "salt")

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                held = table.value[int(length[rows[0]])]
                at = held[np.searchsorted(held[:, 0], rank[rows], side="right") - 1]
                inside = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + inside // at[:, 1]
                offset[rows] = at[:, 3] + inside % at[:, 1] * at[:, 4]
            kept = [k for k, name in enumerate(batch.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + [pa.array(sequence), pa.array(offset)], names=[batch.schema.names[k] for k in kept] + ["sequence_id", "offset"])

    names = [*pieces.columns, "rank"]
    types = dict(pieces.dtypes)
    return ranked.select(*names).mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in names[:-1]) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, added: bool = True) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) cut and packed into sequences of at most ``capacity`` tokens.

    Repeated rows are packed as often as they come; an empty table gives no rows; other columns
    are ignored. The JSON's added tokens have their own ids where texts hold them, as in the ``tokenizers``
    library; without ``added`` they are ordinary text. Texts of equal length in tokens are interchangeable: ties
    go by a hash of doc_id and piece, then by doc_id, piece and start.
    """
    return place_pieces(C.cut(cut_documents(docs, path, capacity, end_id, keep_ids, added)), capacity)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens; see ``pack_documents``."""
    return pack_documents(C.table(spark, sf_dir, "documents"), C.tokenizer_path("byte_bpe_50k.json"))

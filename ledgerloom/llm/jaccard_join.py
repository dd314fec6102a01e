"""Exact Jaccard join on word shingles: a size-aware heavy-light join.

One pass over the texts sends each shingle, as a few bytes, to the shard that counts it; the
shards send back those that several documents hold. Only these can be common to two sets, so
prefixes, verification and all later steps need nothing else. Sets up to a boundary are light:
they are matched by enumerating the subsets of the size that a partner must share. Larger ones
are heavy: they are found in the inverted lists of their prefixes, rarest shingles first. The
boundary is where the estimated cost of both is least.

Equal sets are one class. In each inverted list first a hub meets the others; verified links
join classes to components, and only pairs between different components are looked at again,
until every candidate pair is verified or joined.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

WORDS = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 75, 100
#: Documents of a batch (their number within it takes 10 bits of a key), and bytes of text worked on at once.
BATCH, DOC_BITS, SLICE_BYTES = 1000, 10, 1_000_000
BATCH_CODES = 1 << DOC_BITS
#: Characters of text for each counting shard.
SHARD_CHARS = 8_000_000
#: Sizes that the boundary's cost is reckoned for; beyond, a set has too many subsets to be light at any cost.
MOST_LIGHT = 24
#: Rounds in which hubs meet their lists before all pairs between components do.
HUB_ROUNDS = 2
#: Sets of so many classes are picked by a broadcast of their keys; of more, by a shuffle.
BROADCAST_NODES = 200_000
#: Entries of a long list that meet in one task at most, with as many others.
TILE = 1000
#: Rows of an Arrow batch while sets are compared: two whole sets come with each.
PAIR_ROWS = 48

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_overlap(a, b):
    """Elements that sets of ``a`` and ``b`` elements must share: ceil(NUM * (a + b) / (NUM + DEN))."""
    return -(-(NUM * (a + b)) // (NUM + DEN))


def prefix_length(n):
    """Elements of a set, rarest first, one of which any partner must hold."""
    return n - -(-(NUM * n) // DEN) + 1


def shingle_keys(texts: list[bytes]) -> np.ndarray:
    """Sorted distinct keys of all shingles of a batch: 54 bits of hash, 10 bits of the text's number."""
    out = []
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) < SLICE_BYTES):
            size, b = size + len(texts[b]) + 1, b + 1
        out.append(_slice_keys(texts[a:b], a))
        a = b
    keys = np.concatenate(out) if out else np.zeros(0, np.uint64)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _slice_keys(texts: list[bytes], first: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _SPACE[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    up, down = _powers(len(data) + 1)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)])
    word = _mix((running[stops] - running[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    doc = np.searchsorted(ends, starts, side="right")
    many = np.bincount(doc, minlength=len(texts))
    hashes, owners = [], []
    if len(word) >= WORDS:
        h = np.zeros(len(word) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            h = _mix(h * np.uint64(3) + word[k : k + len(h)] + np.uint64(k))
        inside = doc[: len(h)] == doc[WORDS - 1 :]
        hashes.append(h[inside])
        owners.append(doc[: len(h)][inside])
    begin = np.concatenate([[0], np.cumsum(many)])
    for m in range(1, WORDS):
        short = np.flatnonzero(many == m)
        h = np.full(len(short), m, np.uint64)
        for k in range(m):
            h = _mix(h * np.uint64(5) + word[begin[short] + k])
        hashes.append(h)
        owners.append(short)
    h, doc = np.concatenate(hashes), np.concatenate(owners) + first
    return (h & ~np.uint64((1 << DOC_BITS) - 1)) | doc.astype(np.uint64)


def _id_bits(shards: int) -> int:
    return min(54, 40 + max(1, shards - 1).bit_length())


def _pack(ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted ids as differences of the least width, then the columns."""
    steps = np.diff(ids, prepend=np.uint64(0))
    width = 4 if not len(steps) or int(steps[1:].max(initial=0)) < 2**32 else 8
    head = np.array([len(ids), width, int(ids[0]) if len(ids) else 0], np.uint64).tobytes()
    steps[:1] = 0
    return head + steps.astype(f"<u{width}").tobytes() + b"".join(c.tobytes() for c in columns)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    n, width, first = (int(x) for x in np.frombuffer(blob, np.uint64, 3))
    at = 24 + n * width
    out = [np.cumsum(np.frombuffer(blob, f"<u{width}", n, 24), dtype=np.uint64) + np.uint64(first)]
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _thin(ids: np.ndarray) -> bytes:
    """Ids in as few bytes each as the largest needs (at most 7); the first byte says how many."""
    width = max(1, -(-int(ids.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _thick(blob: bytes) -> np.ndarray:
    """The ids of ``_thin``."""
    part = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(part), 8), np.uint8)
    out[:, : blob[0]] = part
    return out.view("<u8").ravel()


_ROUTED = "shard int, batch long, kind int, blob binary"
_SETS = "row long, doc_id long, n int, key_a long, key_b long, nu binary, prefix binary, light double, heavy double"


def _route(docs: DataFrame, shards: int) -> DataFrame:
    """For each batch rows about its documents (kinds 0 and 2), and for each shard one with its shingles (kind 1).

    A shard gets a shingle once from a batch: with the document's number, or if several hold it with
    ``BATCH_CODES`` more than how many do. Which these are stays with the batch (kind 2), so that a shingle
    of all documents is as many entries as there are batches.
    """
    bits = _id_bits(shards)

    def run(batches):
        from pyspark import TaskContext

        edges = np.array([-(-(s << bits) // shards) for s in range(1, shards)], np.uint64)
        number = 0
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                name = TaskContext.get().partitionId() << 30 | number
                number += 1
                texts = C.text_bytes(batch.column("text"))
                keys = shingle_keys(texts)
                doc = (keys & np.uint64(BATCH_CODES - 1)).astype(np.uint16)
                n = np.bincount(doc, minlength=len(texts)).astype(np.int32)
                by_doc = np.argsort(doc, kind="stable")
                own = np.split((keys >> np.uint64(DOC_BITS))[by_doc], np.cumsum(n)[:-1])
                digests = b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own)
                ids = batch.column("doc_id")
                known = np.array([x is not None for x in ids.to_pylist()], bool)
                about = np.array([len(texts)], np.int64).tobytes() + ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() + known.tobytes() + n.tobytes() + digests
                short = keys >> np.uint64(64 - bits)
                first = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(short)))
                local = np.repeat(many > 1, many)
                code = np.where(many > 1, BATCH_CODES + many, doc[first]).astype(np.uint16)
                rows = [(shards + name % shards, name, 0, about)]
                if local.any():
                    rows.append((shards + name % shards, name, 2, _pack(short[local], doc[local])))
                distinct = short[first]
                cuts = np.concatenate([[0], np.searchsorted(distinct, edges), [len(distinct)]])
                rows += [(s, name, 1, _pack(distinct[a:b], code[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "batch", "kind", "blob"])

    return docs.mapInArrow(run, _ROUTED)


def _count_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a shard: for each batch the shingles that several documents hold, with how many do."""
    about = rows[rows.kind != 1]
    rows = rows[rows.kind == 1]
    if not len(rows):
        return about
    parts = [_unpack(b, np.uint16) for b in rows.blob]
    ids, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    batch = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    del parts
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    many = np.where(code < BATCH_CODES, 1, code.astype(np.int64) - BATCH_CODES)
    held = np.empty(len(ids), np.uint32)
    held[order] = np.repeat(np.add.reduceat(many[order], starts), np.diff(np.append(starts, len(ranked))))
    keep = held > 1
    ids, code, batch, held = ids[keep], code[keep], batch[keep], held[keep]
    cuts = np.searchsorted(batch, np.arange(len(rows) + 1))
    blobs = [_pack(ids[a:b], code[a:b], held[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    out = rows.assign(blob=blobs)[np.diff(cuts) > 0]
    return pd.concat([about, out]) if len(about) else out


def _finish_batch(rows: pd.DataFrame) -> pd.DataFrame:
    """The documents of a batch: number of the row, set size, class key, shared shingles, and the prefix's part of these."""
    about, name = rows[rows.kind == 0].blob.iloc[0], int(rows.batch.iloc[0])
    count = int(np.frombuffer(about, np.int64, 1)[0])
    doc_ids = np.frombuffer(about, np.int64, count, 8)
    known = np.frombuffer(about, bool, count, 8 + 8 * count)
    n = np.frombuffer(about, np.int32, count, 8 + 9 * count)
    keys = np.frombuffer(about, np.int64, 2 * count, 8 + 13 * count).reshape(-1, 2)
    parts = [_unpack(b, np.uint16, np.uint32) for b in rows[rows.kind == 1].blob]
    empty = np.zeros(0, np.uint64)
    ids = np.concatenate([p[0] for p in parts] or [empty])
    doc = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.uint16)])
    held = np.concatenate([p[2] for p in parts] or [np.zeros(0, np.uint32)])
    for blob in rows[rows.kind == 2].blob:
        here, who = _unpack(blob, np.uint16)
        several = np.flatnonzero(doc >= BATCH_CODES)
        several = several[np.argsort(ids[several])]
        total = held[several][np.searchsorted(ids[several], here)]
        single = doc < BATCH_CODES
        ids, doc, held = np.concatenate([ids[single], here]), np.concatenate([doc[single], who]), np.concatenate([held[single], total])
    order = np.lexsort((ids, held, doc))
    ids, held = ids[order], held[order]
    ends = np.cumsum(np.bincount(doc, minlength=count))
    out = []
    for k in range(count):
        a, b, size = int(ends[k - 1]) if k else 0, int(ends[k]), int(n[k])
        unique = size - (b - a)
        want = prefix_length(size) - unique if size else 0
        nu = prefix = None
        light = heavy = 0.0
        if want > 0 and b > a:
            own = ids[a:b]
            prefix, nu = _thin(own[:want]), _thin(np.sort(own))
            heavy = float(held[a : a + want].sum())
            light = float(sum(math.comb(b - a, least_overlap(size, m)) for m in partner_sizes(size))) if size <= MOST_LIGHT else math.inf
        out.append((name << DOC_BITS | k, int(doc_ids[k]) if known[k] else None, size, int(keys[k, 0]), int(keys[k, 1]), nu, prefix, min(light, 1e300), heavy))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _SETS.split(", ")]).astype({"doc_id": "Int64"})


def partner_sizes(n: int) -> range:
    """Sizes of sets that can be similar to one of ``n`` elements."""
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def signatures(nu: np.ndarray, prefix: np.ndarray, n: int, boundary: int) -> list[tuple[int, int]]:
    """Of a light set subset hashes (negative), of a heavy one and of sets near the boundary prefix shingles.

    With each comes how many elements the set has from there on, in the order of rarity.
    """
    out = []
    if n <= boundary:
        for m in partner_sizes(n):
            if m <= boundary:
                for subset in itertools.combinations(nu.tolist(), least_overlap(n, m)):
                    digest = hashlib.blake2b(np.array([min(n, m), max(n, m), *subset], np.uint64).tobytes(), digest_size=8).digest()
                    out.append((int.from_bytes(digest, "little") >> 1 | -(2**63), n))
    if n > boundary or DEN * n >= NUM * (boundary + 1):
        out += zip(prefix.astype(np.int64).tolist(), range(len(nu), 0, -1))
    return out


def overlap_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets are similar, counted exactly over their shared shingles."""
    pairs = C.cut(pairs, per_core=1)
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("b").alias("node"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("e")
    counts = C.cut(pairs.select(ends).groupBy("e.node").agg(F.sum("e.x").alias("k_a"), F.sum("e.y").alias("k_b")), per_core=1)
    needed = counts.select("node")
    if needed.count() <= BROADCAST_NODES:
        needed = F.broadcast(needed)
    sets = sets.select("node", "n", "nu").join(needed, "node", "left_semi")
    C.small_batches(pairs.sparkSession, PAIR_ROWS)
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("nu").alias("nu_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("nu").alias("nu_b"))

    def run(frames):
        for f in frames:
            keep = []
            for n_a, n_b, x, y in zip(f.n_a, f.n_b, f.nu_a, f.nu_b):
                x, y = _thick(x), _thick(y)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(DEN * common >= NUM * (n_a + n_b - common))
            yield f.loc[keep, ["a", "b"]]

    # A hub is in as many pairs as its lists are long.
    met = C.hot_join(pairs, left, "a", "k_a", "b", counts=counts.select(F.col("node").alias("a"), "k_a"))
    met = C.hot_join(met, right, "b", "k_b", "a", counts=counts.select(F.col("node").alias("b"), "k_b"))
    return met.select("a", "b", "n_a", "n_b", "nu_a", "nu_b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that edges (a, b) lead to, by alternating stars."""

    def state(df: DataFrame):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    now = C.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), per_core=1)
    before = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = C.cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), per_core=1)
        after = state(now)
        if before == after:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = after


def _sizes(comp: DataFrame) -> DataFrame:
    """(comp, size): how many nodes each component of several has."""
    return C.cut(comp.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1"), per_core=1)


def _merged(comp: DataFrame, sizes: DataFrame, links: DataFrame) -> DataFrame:
    """Components after the links (a, b) between nodes are added."""
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    new = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return C.cut(C.hot_join(comp, new, "comp", "size", "node", "left", sizes).select("node", F.coalesce("to", "comp").alias("comp")), per_core=1)


def link_classes(sets: DataFrame) -> DataFrame:
    """(node, comp) of the classes in ``sets`` (node, n, nu, prefix, light, heavy) that signatures bring together."""
    by_size = {r["n"]: (r["light"], r["heavy"]) for r in sets.where(F.col("n") <= MOST_LIGHT).groupBy("n").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).collect()}
    cost = lambda x: sum(light if n <= x else heavy for n, (light, heavy) in by_size.items())
    boundary = min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))

    def run(frames):
        for f in frames:
            out = [(s, node, n, rest) for node, n, nu, prefix in zip(f.node, f.n, f.nu, f.prefix) for s, rest in signatures(_thick(nu), _thick(prefix), n, boundary)]
            yield pd.DataFrame(out, columns=["sig", "node", "n", "rest"])

    C.small_batches(sets.sparkSession, 10 * PAIR_ROWS)
    every = sets.select("node", "n", "nu", "prefix").mapInPandas(run, "sig long, node long, n int, rest int")
    lists = C.cut(every, per_core=1)
    shared = C.cut(lists.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1"), per_core=1)
    lists = C.cut(C.hot_join(lists, shared, "sig", "k", "node"), per_core=1)
    comp = C.cut(lists.select("node").distinct().withColumn("comp", F.col("node")), per_core=1)

    def possible(n, rest, other_n, other_rest):
        """What two sets have from their first common shingle on must hold all that they would share."""
        near = F.least(n, other_n) * DEN >= F.greatest(n, other_n) * NUM
        return near & (F.least(rest, other_rest).cast("long") * (NUM + DEN) >= (F.col(n).cast("long") + F.col(other_n)) * NUM)

    for step in itertools.count():
        sizes = _sizes(comp)
        sized = C.hot_join(comp, sizes, "comp", "size", "node", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        placed = lists.join(sized, "node")
        # Hubs are the sets with most left of them, and by turns the largest component's.
        order = F.struct(-F.col("size"), F.xxhash64("node", F.lit(step))) if step % 2 else F.struct(-F.floor(F.col("rest") * 64 / F.col("n")), F.xxhash64("node", F.lit(step)))
        split = placed.groupBy("sig").agg(F.max("k").alias("k"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(order.alias("h"), "node", "n", "rest", "comp")).alias("hub")).where("low <> high")
        if step < HUB_ROUNDS:
            hubs = C.cut(split.select("sig", "k", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.rest").alias("hub_rest"), F.col("hub.comp").alias("hub_comp")), per_core=1)
            met = C.hot_join(placed.drop("k"), hubs, "sig", "k", "node").where((F.col("comp") != F.col("hub_comp")) & possible("n", "rest", "hub_n", "hub_rest"))
            pairs = met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        else:
            # Long lists are cut into tiles, and each pair of tiles meets apart.
            open_lists = C.hot_join(placed.drop("k"), C.cut(split.select("sig", "k"), per_core=1), "sig", "k", "node")
            tiles = F.ceil(F.col("k") / TILE).cast("int")
            open_lists = C.cut(open_lists.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")), per_core=1)
            one = open_lists.select("sig", "node", "n", "rest", "comp", F.col("tile").alias("i"), F.explode(F.expr("sequence(tile, tiles - 1)")).alias("j"))
            other = open_lists.select("sig", F.col("node").alias("o"), F.col("n").alias("o_n"), F.col("rest").alias("o_rest"), F.col("comp").alias("o_comp"), F.explode(F.expr("sequence(0, tile)")).alias("i"), F.col("tile").alias("j"))
            pairs = one.join(other, ["sig", "i", "j"]).where(((F.col("i") < F.col("j")) | (F.col("node") < F.col("o"))) & (F.col("comp") != F.col("o_comp")) & possible("n", "rest", "o_n", "o_rest"))
            pairs = pairs.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
        links = C.cut(overlap_links(pairs.distinct(), sets), per_core=1)
        comp = _merged(comp, sizes, links)
        if step >= HUB_ROUNDS:
            return comp


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, key_a, key_b, nu, prefix, light, heavy) for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    C.small_batches(spark, BATCH)
    docs = C.pick(docs, "doc_id", "text")
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-int(chars) // SHARD_CHARS))
    counted = _route(docs, shards).groupBy("shard").applyInPandas(_count_shard, _ROUTED)
    return C.cut(counted.groupBy("batch").applyInPandas(_finish_batch, _SETS), per_core=8)


def similar_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Words are what white space separates, A-Z lower-cased; a set is a text's distinct 5-word
    shingles, or its whole sequence if shorter. Two rows link if their sets' Jaccard similarity
    is 0.75 or more; ``component_id`` is the smallest doc_id that links lead to. Null and empty
    texts have no shingles and no links. A null doc_id stays null. Repeated rows are linked as
    any equal texts are; other columns are ignored.
    """
    rows = shingle_sets(docs)
    # A class is named by its first row; equal sets agree in their size and 128 bits of digest.
    key, node = ["key_a", "key_b", "n"], F.min("row").alias("node")
    # A null prefix means that the set has a partner only among its equals.
    sets = rows.where("nu IS NOT NULL").groupBy(*key).agg(node, F.first("nu").alias("nu"), F.first("prefix").alias("prefix"), F.first("light").alias("light"), F.first("heavy").alias("heavy"))
    sets = C.cut(sets.drop("key_a", "key_b"), per_core=8)
    comp = link_classes(sets)
    classes = rows.where("n > 0").groupBy(*key).agg(node, F.min("doc_id").alias("least"), F.count("*").alias("k"))
    placed = C.cut(classes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), per_core=1)
    lowest = C.cut(placed.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("k").alias("rows"), F.count("*").alias("classes")).where("rows > 1"), per_core=1)
    shared = C.cut(C.hot_join(placed, lowest, "comp", "classes", "node").select(*key, "k", "component_id"), per_core=1)
    found = C.hot_join(rows.select("row", "doc_id", *key), shared, key, "k", "row", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with one row of each component: that of the smallest doc_id.

    Rows without shingles and rows without doc_id stay, and so do all rows of the doc_id that is kept.
    """
    found = similar_components(docs).where("doc_id IS NOT NULL AND n_shingles > 0 AND component_id <> doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``; see ``similar_components``."""
    return similar_components(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""

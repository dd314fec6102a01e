"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted into buckets of near-equal length and kept as blocks. A query's threshold
is its k-th best score so far. Blocks whose longest vector can't reach it aren't moved; in
the others the threshold gives a local cosine, by which either lengths are cut off (a low one)
or a partial product over the query's largest coordinates plus a Cauchy-Schwarz bound of the
rest is tried first (a high one). What is left is verified with whole products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

#: Rows in a block of candidates, and in a block of queries (less than 1,024); blocks in a tile; parts that one dimension is dealt into.
BLOCK_ROWS, QUERY_ROWS, TILE, SALTS = 2048, 512, 16, 32
#: Above this local cosine the coordinate bound is tried before whole products.
COORDINATE_COSINE = 0.5
#: Floats hold integers below this exactly.
_EXACT = 2**53


def floor_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v array<double> of whole numbers, norm) of vectors that are whole and finite; rows without an id take no part."""
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    v = F.transform(x, lambda e: F.rint(e.cast("double") * F.lit(float(scale)) - F.pmod(e.cast("double") * F.lit(float(scale)), F.lit(1.0))))
    out = C.pick(vectors, "vec_id", "embedding").where(good & F.col("vec_id").isNotNull()).select("vec_id", F.size(x).alias("dim"), v.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)))


def _matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, dim)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number products; by Python's integers where floats might round."""
    if not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < _EXACT:
        return q @ c.T
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return exact


def search_block(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list, dict]:
    """(query row, candidate row, score) that may be among the k best, and counts of what was pruned.

    ``floor`` is a score that the k-th best of each query is known to reach.
    """
    counts = {"passed": 0, "length": 0, "coordinate": 0, "verified": 0}
    order = np.argsort(-np.sqrt((c * c).sum(1)), kind="stable")
    c, c_ids = c[order], c_ids[order]
    length = np.sqrt((c * c).sum(1)) * (1 + 1e-12)
    q_length = np.sqrt((q * q).sum(1)) * (1 + 1e-12)
    live = np.flatnonzero(q_length * (length[0] if len(length) else 0) >= floor)
    counts["passed"] = len(q) - len(live)
    out = []
    if not len(live) or not len(c):
        return out, counts
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(q_length[live] * length[0] > 0, floor[live] / (q_length[live] * length[0]), -1.0)
        reach = np.where((floor[live] > 0) & (q_length[live] > 0), floor[live] / q_length[live], 0.0)
    last = np.searchsorted(-length, -reach * (1 - 1e-12), side="right")
    last[floor[live] <= 0] = len(c)
    counts["length"] = int((len(c) - last).sum())
    high = (cosine > COORDINATE_COSINE) & (q.shape[1] >= 8)
    for way in (False, True):
        rows = live[high == way]
        if not len(rows):
            continue
        most = int(last[high == way].max())
        part = c[:most]
        if way:
            focus = np.argsort(-np.abs(q[rows]).sum(0), kind="stable")[: max(4, q.shape[1] // 4)]
            rest = np.setdiff1d(np.arange(q.shape[1]), focus)
            bound = q[np.ix_(rows, focus)] @ part[:, focus].T + np.sqrt((q[np.ix_(rows, rest)] ** 2).sum(1))[:, None] * np.sqrt((part[:, rest] ** 2).sum(1))[None, :]
            may = bound * (1 + 1e-9) + 1e-6 >= floor[rows][:, None]
            counts["coordinate"] += int((~may).sum())
            keep = np.flatnonzero(may.any(0))
            part, ids = part[keep], c_ids[:most][keep]
        else:
            ids = c_ids[:most]
        score = _products(q[rows], part)
        score_ok = (score >= floor[rows][:, None]) & (ids[None, :] != q_ids[rows][:, None])
        counts["verified"] += score.size
        for r, row in enumerate(rows):
            hit = np.flatnonzero(score_ok[r])
            if len(hit) > k:
                hit = hit[np.lexsort((ids[hit], -score[r, hit]))[:k]]
            out += [(int(row), int(ids[h]), int(score[r, h])) for h in hit]
    return out, counts


def _blocks(rows: DataFrame, size: int, n: int, by_norm: bool) -> DataFrame:
    """Rows packed into blocks of at most ``size`` of one dimension; by_norm: near-equal lengths together."""
    parts = max(1, math.ceil(n / size))
    dealt = rows.repartitionByRange(parts, "dim", F.col("norm").desc(), "vec_id") if by_norm else rows.repartition(parts, "vec_id")
    schema = "block long, dim int, longest double, ids binary, data binary"

    def pack(frames):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, {}
        for frame in frames:
            for dim, g in frame.groupby("dim"):
                held.setdefault(int(dim), []).append(g)
            for dim in [d for d, gs in held.items() if sum(map(len, gs)) >= size]:
                yield one(task, made, dim, held.pop(dim))
                made += 1
        for dim, gs in held.items():
            yield one(task, made, dim, gs)
            made += 1

    def one(task, made, dim, gs):
        g = pd.concat(gs)
        data = np.stack(g["v"].to_numpy()) if dim else np.zeros((len(g), 0))
        return pd.DataFrame({"block": [task << 24 | made], "dim": [dim], "longest": [float(g["norm"].max())], "ids": [g["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.astype(np.float64).tobytes()]})

    return dealt.mapInPandas(pack, schema)


def _held(r) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    ids = np.frombuffer(r.ids, np.int64)
    return ids, _matrix(r.data, r.dim) if r.dim else np.zeros((len(ids), 0))


def _floors(q_blocks: DataFrame, c_blocks: DataFrame, k: int) -> DataFrame:
    """(block, dim, floors, reach): scores that the k-th best of each query reaches, and the least length of a candidate that may do so.

    They come from one block of the dimension, that of the longest vectors.
    """
    first = c_blocks.groupBy("dim").agg(F.max_by(F.struct("ids", "data"), F.struct("longest", -F.col("block"))).alias("first"))
    # One dimension may hold all queries, so the block meets them in parts.
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("dim", "salt", F.col("first.ids").alias("c_ids"), F.col("first.data").alias("c_data"))

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                q_ids, q = _held(r)
                c_ids = np.frombuffer(r.c_ids, np.int64)
                score = _products(q, _matrix(r.c_data, r.dim) if r.dim else np.zeros((len(c_ids), 0))).astype(np.float64)
                score[q_ids[:, None] == c_ids[None, :]] = -np.inf
                best = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
                best = best - np.abs(best) * 1e-12  # floats may round up
                length = np.sqrt((q * q).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(best <= 0, 0.0, best / length)
                out.append((r.block, r.dim, best.tobytes(), float(reach.min()) * (1 - 1e-9)))
            yield pd.DataFrame(out, columns=["block", "dim", "floors", "reach"])

    met = q_blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(first, ["dim", "salt"])
    return met.select("block", "dim", "ids", "data", "c_ids", "c_data").mapInPandas(run, "block long, dim int, floors binary, reach double")


def cells(q_blocks: DataFrame, floors: DataFrame, c_blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries' tiles and candidates' tiles (block -> tile), and the pairs of tiles (q_tile, c_tile) that may hold a best score.

    A tile is up to ``TILE`` blocks of one dimension and near length. Pairs are chosen by two numbers of each tile.
    """

    def tiled(of: DataFrame, by, name: str) -> DataFrame:
        # Blocks are numbered by their tasks, which are in order of dimension and length.
        place = F.shiftright("block", 24) if by is None else by
        return of.withColumn(name, F.xxhash64("dim", F.floor(place / TILE)))

    q_meta = tiled(floors.select("block", "dim", "reach"), None, "q_tile")
    c_meta = tiled(c_blocks.select("block", "dim", "longest"), None, "c_tile")
    q_tiles = q_meta.groupBy("q_tile", "dim").agg(F.min("reach").alias("reach")).withColumn("salt", F.pmod("q_tile", F.lit(SALTS)).cast("int"))
    c_tiles = c_meta.groupBy("c_tile", "dim").agg(F.max("longest").alias("longest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = q_tiles.join(c_tiles, ["dim", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("q_tile", "c_tile")
    return q_meta.select("block", "q_tile"), c_meta.select("block", "c_tile"), pairs


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query, ties to smaller ids.

    Both tables hold ``floor_vectors`` rows. A query is not compared with its own id; vectors
    of another dimension than the query's take no part. Pairs of tiles of blocks are chosen by
    their lengths alone, before any vector moves; then both tiles of a pair meet in one task, a
    bounded number of vectors. Scores beyond 64 bits are held at the range's ends and tie there.
    Repeated ids are separate rows.
    """
    spark = queries.sparkSession
    C.small_batches(spark, 2000)
    queries, candidates = (C.cut(C.pick(x, "vec_id", "dim", "v", "norm")) for x in (queries, candidates))
    q_blocks = C.cut(_blocks(queries, QUERY_ROWS, queries.count(), False))
    c_blocks = C.cut(_blocks(candidates, BLOCK_ROWS, candidates.count(), True))
    C.small_batches(spark, 16)  # rows are whole blocks from here on
    floors = C.cut(_floors(q_blocks, c_blocks, k))
    q_of, c_of, pairs = cells(q_blocks, floors, c_blocks)
    pairs = C.cut(pairs, per_core=1)
    left = q_blocks.drop("longest").join(floors.select("block", "floors"), "block").join(q_of, "block").join(pairs, "q_tile")
    right = c_blocks.drop("longest").join(c_of, "block").join(pairs, "c_tile")

    def verify(q_rows: pd.DataFrame, c_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in q_rows.itertuples():
            q_ids, q = _held(r)
            floor, best = np.frombuffer(r.floors, np.float64).copy(), [[] for _ in q_ids]
            for other in c_rows.itertuples():
                if other.dim != r.dim:
                    continue
                c_ids, c = _held(other)
                for a, b, score in search_block(q, q_ids, floor, c, c_ids, k)[0]:
                    best[a].append((-score, b))
                for a, found in enumerate(best):
                    if len(found) >= k:
                        found.sort()
                        del found[k:]
                    if len(found) >= k:  # the floor rises with what has been found
                        floor[a] = max(floor[a], -float(found[-1][0]) - abs(float(found[-1][0])) * 1e-12)
            out += [(int(q_ids[a]), b, min(max(-s, -(2**63)), 2**63 - 1), (r.block << 10) + a) for a, found in enumerate(best) for s, b in found]
        return pd.DataFrame({n: np.array([x[i] for x in out], np.int64) for i, n in enumerate(("query_id", "vec_id", "score", "q_row"))})

    hits = left.groupBy("q_tile", "c_tile").cogroup(right.groupBy("q_tile", "c_tile")).applyInPandas(verify, "query_id long, vec_id long, score long, q_row long")
    best = Window.partitionBy("query_id", "q_row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 5 best of ``embeddings`` for each row whose vec_id is divisible by 50."""
    vectors = floor_vectors(C.table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

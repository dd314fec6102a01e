"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is over whole Unicode characters, case and script as they are, with marks for a text's
begin and end. Its n-grams grow with the trusted text and are kept sharded by hash; none is
collected or broadcast. A window's log probability is a sum over its suffixes: each n-gram has
one weight, what it adds to the estimate that backs off from it and what is left over after it,

    log p(window) = base + sum over m of weight(last m characters),

so that a document's score is the join of its n-gram counts with the weights. Documents are
worked on in blocks: a block sends each of its distinct n-grams once to the shard that holds it,
and the weights come back to the block's texts. A text is kept if its perplexity is within a
quantile of trusted texts of its language that the model wasn't fitted on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

ORDER = 4
#: Marks beyond Unicode, so that no text holds them; a symbol takes this many bytes of an n-gram.
BEGIN, END, WIDTH = 0x110000, 0x110001, 3
#: Share of the held-out trusted texts of a language that are kept; one trusted text of so many is held out.
QUANTILE, HELD_OUT = 0.995, 4
#: Characters of average text that every text is weighed in with, so that short ones aren't judged by chance.
PRIOR_CHARS = 60
#: Parts that the rows of a language are dealt into when they meet their threshold.
SALTS = 32
#: Bytes of text in a block, symbols that are worked on at once, and characters of all texts for each shard.
BLOCK_BYTES, SLICE, SHARD_CHARS = 16_000_000, 1_000_000, 32_000_000
#: While the model is fitted, no table is broadcast. Spark's own Bloom filter of the trusted ids, of 8 MB
#: whatever their number, keeps other texts out of the shuffle as long as it isn't full; the join decides.
FILTER = {"spark.sql.autoBroadcastJoinThreshold": "-1"} | {
    f"spark.sql.optimizer.runtime.bloomFilter.{k}": v
    for k, v in {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 50), "expectedNumItems": "4000000", "maxNumItems": "4000000", "numBits": "67108864", "maxNumBits": "67108864"}.items()
}


# -- n-grams of texts


def segments(texts: list[str]):
    """Lists of (row, symbols) with at most about ``SLICE`` symbols; together they hold every window once.

    A text's symbols begin with ``ORDER`` marks, for the window before its first character, and
    end with one. Longer texts are cut; each part begins with the symbols that its first window needs.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        for a in range(0, len(text), SLICE):
            b = min(len(text), a + SLICE)
            before = [BEGIN] * ORDER if a == 0 else None
            own = np.frombuffer(text[a if before else a - ORDER + 1 : b].encode("utf-32-le", "surrogatepass"), np.uint32)
            part = np.concatenate([np.array(before or [], np.uint32), own, np.array([END] if b == len(text) else [], np.uint32)])
            if held and size + len(part) > SLICE:
                yield held
                held, size = [], 0
            held.append((row, part))
            size += len(part)
    if held:
        yield held


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_ids(grams: np.ndarray) -> np.ndarray:
    """64-bit ids of n-grams (rows of symbols) of one length."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = _mixed((h + grams[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
    return h


def windows(segment: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows of ``ORDER`` symbols, for each window its number among them, and its row."""
    flat = np.concatenate([s for _, s in segment])
    sizes = np.array([len(s) - ORDER + 1 for _, s in segment], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)])[:-1]
    inside = np.ones(len(flat) - ORDER + 1, bool)
    for k in range(1, ORDER):
        inside[starts[1:] - k] = False
    # Symbols take 21 bits: three in a word, the fourth by the mixed word.
    key = np.zeros(len(flat) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        key = _mixed((key + flat[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(inside)
    _, first, number = np.unique(key[at], return_index=True, return_inverse=True)
    grams = flat[at[first][:, None] + np.arange(ORDER)]
    return grams, number, np.repeat(np.array([row for row, _ in segment]), sizes)


def block_ids(texts: list[str]) -> np.ndarray:
    """Sorted ids of all n-grams, of every order, that the windows of the texts end in."""
    found = np.zeros(0, np.uint64)
    for segment in segments(texts):
        grams, _, _ = windows(segment)
        found = np.unique(np.concatenate([found, *(gram_ids(grams[:, ORDER - m :]) for m in range(1, ORDER + 1))]))
    return found


def block_sums(texts: list[str], ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text the sum of weights over its windows."""
    out = np.zeros(len(texts))
    for segment in segments(texts):
        grams, number, row = windows(segment)
        value = sum(weights[np.searchsorted(ids, gram_ids(grams[:, ORDER - m :]))] for m in range(1, ORDER + 1))
        out += np.bincount(row, value[number], len(texts))
    return out


def _bytes(grams: np.ndarray) -> pa.Array:
    """N-grams of one length as binary values of ``WIDTH`` bytes a symbol."""
    size = grams.shape[1] * WIDTH
    data = np.ascontiguousarray(grams.astype(">u4")).view(np.uint8).reshape(len(grams), -1, 4)[:, :, 1:]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(grams), [None, pa.py_buffer(np.ascontiguousarray(data).tobytes())]).cast(pa.binary())


def symbols_of(grams: list[bytes]) -> np.ndarray:
    """Rows of symbols of binary n-grams of one length."""
    raw = np.frombuffer(b"".join(grams), np.uint8).reshape(len(grams), -1, WIDTH).astype(np.uint32)
    return raw[:, :, 0] << 16 | raw[:, :, 1] << 8 | raw[:, :, 2]


def _decoded(column: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") for b in C.text_bytes(column)]


# -- the model


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(gram, n): windows of the highest order over all of ``texts`` (text); tasks add up their own before the shuffle."""
    C.small_batches(texts.sparkSession)

    def run(batches):
        def sums(parts):
            grams = np.concatenate([g for g, _ in parts])
            _, first, number = np.unique(gram_ids(grams), return_index=True, return_inverse=True)
            return grams[first], np.bincount(number, np.concatenate([n for _, n in parts])).astype(np.int64)

        held = []
        for batch in batches:
            for segment in segments(_decoded(batch.column("text"))):
                grams, number, _ = windows(segment)
                held.append((grams, np.bincount(number, minlength=len(grams))))
                if len(held) > 1 and sum(len(g) for g, _ in held[1:]) > max(len(held[0][0]), SLICE):
                    held = [sums(held)]
        if not held:
            return
        grams, n = sums(held)
        real = grams[:, -1] != BEGIN  # the window before the text isn't predicted
        grams, n = grams[real], n[real]
        for a in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([_bytes(grams[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["gram", "n"])

    return C.pick(texts, "text").mapInArrow(run, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(level: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams have the counts 1 to 4."""
    r = level.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x or 0) for x in r)
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, top: min(max(d, 0.05), top)
    return clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.95), clip(3 - 4 * y * n4 / n3, 2.95)


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """(gram, w) of all orders, and the base: log p of a window is the base and the weights of its suffixes.

    Below the highest order an n-gram counts by how many symbols it was seen after. A weight is
    log p(gram) less what backing off from it would give, plus log of what is left over after the
    gram as a context. The base is that of a symbol never seen: one share of the symbols seen and one.
    """
    levels = [C.cut(counts, per_core=1)]
    for k in range(ORDER - 1, 0, -1):
        levels.append(C.cut(levels[-1].groupBy(F.expr(f"substring(gram, {WIDTH + 1}, {WIDTH * k})").alias("gram")).agg(F.count("*").alias("n")), per_core=1))
    levels.reverse()
    symbols = levels[0].count() + 1
    weights, lower, base = [], None, -float(np.log(symbols))
    for k, level in enumerate(levels, 1):
        d1, d2, d3 = _discounts(level)
        rows = level.withColumn("d", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
        if k == 1:
            r = rows.agg(F.sum("n").alias("total"), F.sum("d").alias("d")).first()
            if not r["total"]:
                return level.select("gram", F.lit(0.0).alias("w")), base
            left = F.lit(float(r["d"]) / r["total"])
            joined = rows.withColumns({"total": F.lit(r["total"]), "left": left, "q": F.lit(1 / symbols)})
            base += float(np.log(float(r["d"]) / r["total"]))
        else:
            rows = rows.withColumn("context", F.expr(f"substring(gram, 1, {WIDTH * (k - 1)})"))
            context = C.cut(rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left")), per_core=1)
            weights.append(context.select(F.col("context").alias("gram"), F.log("left").alias("w")))
            joined = rows.join(context, "context").withColumn("suffix", F.expr(f"substring(gram, {WIDTH + 1}, {WIDTH * (k - 1)})")).join(lower, "suffix")
        p = C.cut(joined.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("q")).alias("p"), (F.col("left") * F.col("q")).alias("less")), per_core=1)
        weights.append(p.select("gram", (F.log("p") - F.log("less")).alias("w")))
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("q"))
    out = weights[0]
    for w in weights[1:]:
        out = out.unionByName(w)
    return C.cut(out.groupBy("gram").agg(F.sum("w").alias("w")), per_core=1), base


# -- scores


def _shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return ((ids >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def _blocks(batches, keep: tuple[str, ...]):
    """(key, batches of rows, texts) of each block of a task's rows; the key is a digest of what the block holds."""

    def one(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        texts = C.text_bytes(rows.column("text"))
        digest = hashlib.blake2b(digest_size=16)
        for text in texts:
            digest.update(len(text).to_bytes(8, "little") + text)
        for c in keep:
            digest.update(repr(rows.column(c).to_pylist()).encode())
        return digest.digest(), rows, [t.decode("utf-8", "replace") for t in texts]

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield one(held)
            held, size = [], 0
    if held:
        yield one(held)


def _requests(docs: DataFrame, shards: int, keep: tuple[str, ...]) -> DataFrame:
    """(shard, block, ids): for each block and shard the distinct n-grams that the block asks for."""

    def run(batches):
        for key, _, texts in _blocks(batches, keep):
            ids = block_ids(texts)
            cuts = np.searchsorted(_shard_of(ids, shards), np.arange(shards + 1))
            parts = [(s, ids[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([key] * len(parts), pa.binary()), pa.array([p for _, p in parts], pa.binary())], names=["shard", "block", "ids"])

    # Blocks of equal rows ask for the same and share the answer.
    return docs.mapInArrow(run, "shard int, block binary, ids binary")


def _texts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(block, part, texts): the rows of each block, compressed."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for number, (key, rows, _) in enumerate(_blocks(batches, keep)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([task | number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "part", "texts"])

    return docs.mapInArrow(run, "block binary, part long, texts binary")


def _model_rows(weights: DataFrame, shards: int) -> DataFrame:
    """(shard, id, w) of the model."""

    def run(batches):
        for batch in batches:
            grams, w = batch.column("gram").to_pylist(), batch.column("w").to_numpy(zero_copy_only=False)
            size = np.array([len(g) for g in grams])
            for m in np.unique(size):
                at = np.flatnonzero(size == m)
                ids = gram_ids(symbols_of([grams[k] for k in at]))
                yield pa.RecordBatch.from_arrays([pa.array(_shard_of(ids, shards).astype(np.int32)), pa.array(ids.view(np.int64)), pa.array(w[at])], names=["shard", "id", "w"])

    return weights.mapInArrow(run, "shard int, id long, w double")


def _answer(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """(block, shard, weights) for each request of a shard; what the model hasn't seen weighs nothing."""
    known = model["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    known, w = known[order], model["w"].to_numpy(np.float32)[order]
    out = []
    for shard, block, blob in zip(asked["shard"], asked["block"], asked["ids"]):
        ids = np.frombuffer(blob, np.uint64)
        if len(known):
            at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
            own = np.where(known[at] == ids, w[at], np.float32(0))
        else:
            own = np.zeros(len(ids), np.float32)
        out.append((block, shard, blob, own.astype(np.float32).tobytes()))
    return pd.DataFrame(out, columns=["block", "shard", "ids", "weights"])


def score_texts(docs: DataFrame, weights: DataFrame, base: float, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns, (n_symbols, log_sum) for each row of ``docs`` (text)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    types = dict(docs.dtypes)
    docs = C.pick(docs, *keep, "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = C.cut(docs)  # read twice, and blocks must be the same both times
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shards = max(8, -(-int(chars) // SHARD_CHARS))
    asked, model = _requests(docs, shards, keep), _model_rows(weights, shards)
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInPandas(_answer, "block binary, shard int, ids binary, weights binary")
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", n_symbols long, log_sum double"

    def finish(held: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        # A block that comes twice (equal rows) has equal answers.
        answered = answered.drop_duplicates("shard").sort_values("shard")
        ids = np.frombuffer(b"".join(answered["ids"]), np.uint64)
        own = np.frombuffer(b"".join(answered["weights"]), np.float32).astype(np.float64)
        out = []
        for blob in held["texts"]:
            rows = pa.ipc.open_stream(blob).read_all()
            texts = _decoded(rows.column("text"))
            size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
            if size.any() and not len(ids):
                raise RuntimeError("the documents changed between two passes over them")
            sums = block_sums(texts, ids, own) + size * base
            out.append(pa.Table.from_arrays([*(rows.column(c) for c in keep), pa.array(size), pa.array(sums)], names=[*keep, "n_symbols", "log_sum"]))
        return pa.concat_tables(out).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) if out else pd.DataFrame(columns=[*keep, "n_symbols", "log_sum"])

    return _texts(docs, keep).groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, schema)


def _trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a trusted id. Ids are never broadcast, since they grow with the data."""
    return docs.join(ids, "doc_id", "left_semi")


def judge_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_symbols, perplexity, threshold, keep) for each row of ``docs`` (doc_id, lang, text).

    Trusted are rows that ``labels`` (doc_id, quality) gives quality 1. One of ``HELD_OUT`` of them, by
    hash of doc_id, isn't fitted on and gives the thresholds; where a language has none held out, its
    other trusted texts do, and where it has no trusted text, all held-out ones. Without any trusted
    text every row is kept. A null language is its own; a null or empty text has the average
    perplexity. Bytes that aren't UTF-8 count as replacement characters. Repeated rows give repeated
    results; other columns are ignored.
    """
    docs = C.pick(docs, "doc_id", "lang", "text")
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    trusted_ids = C.pick(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id")
    texts = docs.where("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    with C.settings(docs.sparkSession, FILTER):
        weights, base = kneser_ney(count_ngrams(_trusted(texts.where(~aside), trusted_ids.where(~aside))))
    rows = C.cut(score_texts(docs, weights, base, ("doc_id", "lang")))
    known = rows.join(trusted_ids, "doc_id", "left_semi").withColumn("aside", aside)
    mean = known.agg((F.sum("log_sum") / F.sum("n_symbols")).alias("m")).first()["m"]
    mean = base if mean is None else float(mean)
    perplexity = F.exp(-(F.col("log_sum") + F.lit(PRIOR_CHARS * mean)) / (F.col("n_symbols") + PRIOR_CHARS)).alias("perplexity")
    known, rows = known.select("lang", "aside", perplexity), rows.select("*", perplexity)
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    held = F.percentile_approx(F.when(F.col("aside"), F.col("perplexity")), F.lit(quantile), F.lit(10000))
    everywhere = known.agg(F.coalesce(held, limit).alias("t")).first()["t"]
    # A language may hold most rows, so the join by language is salted.
    key, salt = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    by_lang = known.groupBy(key.alias("key")).agg(F.coalesce(held, limit).alias("own")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    rows = rows.withColumn("key", key).withColumn("salt", salt).join(by_lang, ["key", "salt"], "left").withColumn("threshold", F.coalesce("own", F.lit(everywhere).cast("double")))
    return rows.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def op10_quality_lm(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` judged; trusted are rows of quality 1."""
    return judge_documents(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))

"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and word beginnings that labelled rows tie to
toxicity (dealt into several voters by strength), a fixed lexicon, and patterns. A generative model with
two classes estimates by expectation maximisation how often each voter speaks up in either
class, and from residual covariances which voters repeat each other; these count for less. A
linear classifier is then trained on the posterior labels and scores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _common as C

#: Labelled rows that the model is fitted on, at most; those of least hash of their id.
SAMPLE_ROWS = 20_000
#: Words and beginnings that a lexicon holds, at most, and voters that they are dealt into.
LEXICON_SIZE, LEXICON_VOTERS = 3000, 8
#: Labelled toxic rows that must hold an entry: so many, and this share of them.
LEAST_ROWS, LEAST_SHARE = 4, 0.01
#: How much likelier an entry must be in a toxic row than in another.
LEAST_LIFT = 60
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

#: Fixed values.
INSULTS = frozenset("clown disgusting dumb fool idiot imbecile jerk loser moron pathetic scum stupid trash ugly vermin worthless".split())

WORDS = re.compile(r"[^\W\d_]+").findall
PATTERNS = {
    "shouting": re.compile(r"!{2,}"),
    "capitals": re.compile(r"\b[A-Z]{4,}\b.*\b[A-Z]{4,}\b", re.S),
    "addressed": re.compile(r"\byou(?:'re| are)?\s+(?:an?\s+|such\s+an?\s+)?(?:" + "|".join(sorted(INSULTS)) + r")\b", re.I),
    "masked": re.compile(r"\b[a-z]+[*@#$]{1,3}[a-z]+\b", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|hate|destroy)\s+you\b", re.I),
}


def entries_of(word: str) -> list[str]:
    """The word itself and its beginnings, as lexicon entries."""
    return [word] + [word[:k] + "*" for k in PREFIXES if len(word) > k]


class _Lookup(dict):
    """Word -> numbers of the lexicon's entries that it meets; cleared when large."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple:
        if len(self) > 300_000:
            self.clear()
        found = self[word] = tuple(self.number[e] for e in entries_of(word) if e in self.number)
        return found


@dataclass
class Model:
    lexicon: list = field(default_factory=list)  # entries; the fixed ones first
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0
    label_model: dict = field(default_factory=dict)

    def __post_init__(self):
        self.lookup = _Lookup({e: k for k, e in enumerate(self.lexicon)})

    def hits(self, text: str) -> list[int]:
        """Numbers of the features that ``text`` has: lexicon entries, patterns, then lexicon voters."""
        lookup, n = self.lookup, len(self.lexicon)
        found = {k for w in set(WORDS(text.lower())) for k in lookup[w]}
        voters = {voter_of(k, n) for k in found}
        return sorted(found) + [n + k for k, p in enumerate(PATTERNS.values()) if p.search(text)] + [n + len(PATTERNS) + v for v in sorted(voters)]

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[k] for k in self.hits(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def voter_of(number: int, size: int) -> int:
    """The fixed entries come first and have a voter of their own; the others are dealt by strength."""
    fixed = len(INSULTS)
    return 0 if number < fixed else 1 + (number - fixed) * LEXICON_VOTERS // max(1, size - fixed)


def votes(model_lexicon: list, hits: list[list[int]]) -> np.ndarray:
    """(texts, voters) of whether a voter speaks up."""
    voter = np.array([voter_of(k, len(model_lexicon)) for k in range(len(model_lexicon))] + [1 + LEXICON_VOTERS + k for k in range(len(PATTERNS))] + list(range(1 + LEXICON_VOTERS)))
    out = np.zeros((len(hits), 1 + LEXICON_VOTERS + len(PATTERNS)), bool)
    for r, h in enumerate(hits):
        out[r, voter[h]] = True
    return out


def label_model(vote: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class for each row, and the voters' estimated accuracies and weights."""
    v = vote.astype(float)
    posterior = np.clip(0.02 + 0.95 * (v[:, : 1 + LEXICON_VOTERS].sum(1) > 0), 0.02, 0.97)
    silent = (v[:, : 1 + LEXICON_VOTERS].sum(1) == 0).astype(float)
    rho = np.ones(v.shape[1])
    for step in range(rounds):
        p1, p0 = posterior.sum() + 1, (1 - posterior).sum() + 1
        alpha = (posterior @ v + 0.5) / (p1 + 1)
        beta = ((1 - posterior) @ v + 0.05) / (p0 + 1)
        if step % 10 == 9:  # correlations given the class
            left = v - np.outer(posterior, alpha) - np.outer(1 - posterior, beta)
            scale = np.sqrt((left**2).mean(0)) + 1e-9
            corr = (left.T @ left) / len(v) / np.outer(scale, scale)
            np.fill_diagonal(corr, 0)
            rho = 1 / (1 + np.clip(corr, 0, 1).sum(0))
        prior = np.log(p1 / p0)
        # A voter that stays silent abstains; that no lexicon speaks up is a vote of its own.
        quiet = np.log(((posterior @ silent) + 0.5) / (p1 + 1)) - np.log((((1 - posterior) @ silent) + 0.5) / (p0 + 1))
        z = prior + v @ (rho * np.log(alpha / beta)) + silent * quiet
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, {"alpha": alpha, "beta": beta, "weight": rho, "prior": float(p1 / (p1 + p0))}


def linear_classifier(hits: list[list[int]], target: np.ndarray, size: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse presence features and soft labels."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.array([k for h in hits for k in h], np.int64)
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for t in range(1, steps + 1):
        z = np.bincount(row, w[column], len(hits)) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(column, gap[row], size), gap.sum()) / len(hits)
        grad[:-1] += 1e-5 * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def training_rows(labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``sample_rows`` labelled rows that aren't held out."""
    known = C.pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows that aren't held out; without any, the fixed lexicon decides.

    Where a doc_id has several texts, the one of least hash stands for it. Null texts and ids take no part.
    """
    C.small_batches(docs.sparkSession)
    sample = C.cut(training_rows(labels, sample_rows), per_core=1)
    # One text for each labelled id, so that the sample's bound holds for texts, too.
    found = C.pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    texts = C.cut(found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), per_core=1)

    def count(batches):
        bad: dict[str, int] = {}
        clean: dict[str, int] = {}
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                held = bad if toxic else clean
                for e in {e for w in set(WORDS(text.lower())) for e in entries_of(w)}:
                    held[e] = held.get(e, 0) + 1
        keys = list(bad.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad.get(k, 0) for k in keys], pa.int64()), pa.array([clean.get(k, 0) for k in keys], pa.int64())], names=["entry", "bad", "clean"])

    counts = texts.mapInArrow(count, "entry string, bad long, clean long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_bad, n_clean = totals.get(1, 0), totals.get(0, 0)
    lift = (F.col("bad") + 0.5) / (n_bad + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    mined = counts.where((F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * n_bad)) & (lift >= LEAST_LIFT)).orderBy(lift.desc(), "entry").limit(LEXICON_SIZE).collect() if n_bad else []
    model = Model(sorted(INSULTS) + [r["entry"] for r in mined if r["entry"] not in INSULTS])
    size = len(model.lexicon) + len(PATTERNS) + 1 + LEXICON_VOTERS
    model.weights = np.array([1.0] * len(model.lexicon) + [0.2] * len(PATTERNS) + [4.0] * (1 + LEXICON_VOTERS))

    lexicon = model.lexicon

    def look(batches):
        own = Model(lexicon)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.hits(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "hits"])

    # At most sample_rows lists, each no longer than the lexicon; in order, so that sums don't depend on the layout.
    rows = sorted(texts.mapInArrow(look, "doc_id long, hits array<int>").collect(), key=lambda r: r["doc_id"])
    if len(rows) >= 20 and n_bad and n_clean:
        hits = [r["hits"] for r in rows]
        posterior, model.label_model = label_model(votes(lexicon, hits))
        model.weights, model.bias = linear_classifier(hits, posterior, size)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    Only the text is looked at. A null or empty text has the score of a text without features.
    Repeated rows give repeated results; other columns are ignored.
    """
    C.small_batches(docs.sparkSession)
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    def run(batches):
        own = Model(lexicon, weights, bias)
        for batch in batches:
            score = [own.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array([int(s >= THRESHOLD) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = C.pick(docs, "doc_id", "text").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text isn't scored as toxic."""
    C.small_batches(docs.sparkSession)
    lexicon, weights, bias = model.lexicon, model.weights, model.bias

    def run(batches):
        own = Model(lexicon, weights, bias)
        for batch in batches:
            keep = [own.score(t or "") < THRESHOLD for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` scored; fitted on ``labels.toxic`` of rows not held out."""
    docs = C.table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, C.table(spark, sf_dir, "labels")))

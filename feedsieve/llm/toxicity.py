"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (beginnings and endings of
words) that stand out in toxic rows of the labelled sample.  A generative label model
reads their votes on labelled and unlabelled rows: expectation maximisation estimates the
class balance, how often each voter fires in either class, and the correlations between
voters that are left over within a class, which discount those that say the same.  A gold
label, where there is one, is one more voter of limited trust (`GOLD_TRUST`), and rows without
one weigh little (`UNLABELLED_TRUST`).  The model's posterior labels of the labelled rows train
a linear classifier on hit counts, which scores every text.

The samples are about `TRAIN_ROWS` labelled and as many unlabelled documents (a parameter),
drawn by hash of distinct ids from those that may be learned from.  Scores read the text alone.

Defined cases: a null or empty text has no hits and gets the classifier's score for
none; a null toxic label is no label; of several labels of one id the majority counts, toxic
if they are even; an id that several rows have teaches once, by its least text; repeated rows
are scored row by row; with no label at all, no voter is found and every score is the
prior; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedsieve.llm.common import checkpoint, crc32_mod, hashed_share, small_batches
from feedsieve.llm.shingles import words

TRAIN_ROWS = 16_000
VOTERS = 400
MIN_TOXIC = 8
MIN_EVIDENCE = 20.0
MIN_LIFT = 6.0
GOLD_TRUST = 0.95
#: Weight of an unlabelled row in the label model; at full weight they may draw its classes to other differences between texts.
UNLABELLED_TRUST = 0.02
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
MARKS = ".,;:!?\"'()[]{}<>#*$%&|-"
#: Lengths of the beginnings and endings that may become patterns.
BEGIN, END = (3, 4, 5, 6, 7), (4, 5, 6)
FLUSH = 300_000


def forms(word: str) -> list[str]:
    """The lexicon entry and patterns that a word may match."""
    core = word.strip(MARKS)
    n = len(core)
    if n < 2:
        return []
    return [f"={core}" if n <= 24 else "", *(f"^{core[:k]}" for k in BEGIN if n > k), *(f"{core[-k:]}$" for k in END if n > k)]


def mine(labelled: DataFrame, most: int = VOTERS) -> list[str]:
    """The voters: forms found in far more toxic rows than others, by document counts over the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows():
            keys = [k for k in found if k[0]]
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["form", "toxic", "n"])
            found.clear()
            return out

        for batch in batches:
            texts, labels = batch.column("text").fill_null("").to_pylist(), batch.column("toxic").to_pylist()
            array, cuts = words(texts)
            coded = array.dictionary_encode()
            of_word = [forms(w) for w in coded.dictionary.to_pylist()]
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for label, a, b in zip(labels, cuts[:-1], cuts[1:], strict=True):
                found.update((f, label) for f in {f for c in np.unique(codes[a:b]).tolist() for f in of_word[c]})
                if len(found) > FLUSH:
                    yield rows()
        yield rows()

    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = labelled.select("toxic", "text").mapInArrow(run, "form string, toxic int, n long").groupBy("form").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("o"))
    lift = (F.col("t") + 0.5) / (bad + 1) / ((F.col("o") + 0.5) / (good + 1))
    ranked = counts.where(F.col("t") >= MIN_TOXIC).withColumn("lift", lift).where((F.col("lift") >= MIN_LIFT) & (F.col("t") * F.log("lift") >= MIN_EVIDENCE)).orderBy(F.desc(F.col("t") * F.log("lift")), "form").limit(most)
    return sorted(r["form"] for r in ranked.collect())


def hits(texts: list[str], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hits of each voter in each text, and the words of each text."""
    array, cuts = words(texts)
    coded = array.dictionary_encode()
    own: list[tuple[int, int]] = [(c, v) for c, w in enumerate(coded.dictionary.to_pylist()) for f in forms(w) if (v := place.get(f)) is not None]
    out = np.zeros((len(texts), len(place)), np.float32)
    n = np.diff(cuts)
    if own:
        codes = coded.indices.to_numpy(zero_copy_only=False)
        hit = np.zeros(len(coded.dictionary), bool)
        hit[[c for c, _ in own]] = True
        at = np.flatnonzero(hit[codes])
        doc = np.searchsorted(cuts, at, "right") - 1
        votes: dict[int, list[int]] = {}
        for c, v in own:
            votes.setdefault(c, []).append(v)
        for d, c in zip(doc.tolist(), codes[at].tolist(), strict=True):
            out[d, votes[c]] += 1
    return out, n


def features(counts: np.ndarray, n_words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the linear classifier reads: voters' presence, and their discounted evidence in all and for a word."""
    evidence = (counts > 0) @ weights
    mass = counts @ weights
    extra = np.column_stack((np.ones(len(counts)), evidence, np.log1p(np.maximum(mass, 0)), np.maximum(mass, 0) / np.maximum(n_words, 1) * 10, evidence <= 0))
    return np.concatenate((counts > 0, extra), axis=1)


@dataclass
class LabelModel:
    """Firing rates of the voters in either class, the class balance, and discounts for their correlations within a class."""

    rates: np.ndarray
    prior: float
    discount: np.ndarray
    correlations: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return self.discount * np.log(self.rates[1] / self.rates[0])

    def posterior(self, votes: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """Chance of the toxic class for each row; gold: 1, 0, or -1 for rows without a label."""
        absent = self.discount * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = math.log(self.prior / (1 - self.prior)) + votes @ self.weights + (1 - votes) @ absent
        if gold is not None:
            z = z + np.where(gold < 0, 0, 2 * gold - 1) * math.log(GOLD_TRUST / (1 - GOLD_TRUST))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 15, trust: float = UNLABELLED_TRUST) -> LabelModel:
    """Expectation maximisation; it starts from the labelled rows and then reads all of them, unlabelled ones with less weight."""
    known = gold >= 0
    weight = np.where(known, 1.0, trust)
    p = np.where(gold == 1, GOLD_TRUST, 1 - GOLD_TRUST)
    model = None
    for k in range(rounds):
        rows = known if k == 0 else slice(None)
        v, q, u = votes[rows], p[rows], weight[rows]
        share = np.stack((1 - q, q)) * u
        rates = (share @ v + 0.05) / (share.sum(1, keepdims=True) + 1.0)
        left = (v - np.stack((1 - q, q)).T @ rates) * np.sqrt(u)[:, None]
        scale = np.sqrt((left**2).mean(0)) + 1e-9
        related = (left.T @ left) / len(left) / np.outer(scale, scale)
        np.fill_diagonal(related, 0)
        related[np.abs(related) < 0.3] = 0
        model = LabelModel(np.clip(rates, 1e-5, 1 - 1e-5), float(np.clip(share[1].sum() / u.sum(), 1e-4, 0.999)), 1 / (1 + np.abs(related).sum(1)), related)
        p = model.posterior(votes, gold)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, steps: int = 800, decay: float = 3e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - target) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Scorer:
    voters: list[str]
    weights: np.ndarray
    linear: np.ndarray
    place: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.place = {v: i for i, v in enumerate(self.voters)}

    def score(self, texts: list[str]) -> np.ndarray:
        counts, n = hits(texts, self.place)
        return 1 / (1 + np.exp(-np.clip(features(counts, n, self.weights) @ self.linear, -30, 30)))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(toxic, text) of drawn ids (id, toxic), one row an id."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return rows.groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """About `most` labelled texts that may be learned from."""
    bad = F.col("toxic").cast("int")
    ids = labels.where(bad.isin(0, 1) & F.col("doc_id").isNotNull() & (crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    ids = ids.groupBy(F.col("doc_id").alias("id")).agg((F.avg(bad) >= 0.5).cast("int").alias("toxic"))
    return _texts(docs, hashed_share(ids, F.xxhash64("id"), most))


def unlabelled_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """About `most` texts without a label, with toxic -1; not from the rows that are held out."""
    ids = docs.select(F.col("doc_id").alias("id")).where(F.col("id").isNotNull() & (crc32_mod(F.col("id"), FOLDS) != HELD_OUT)).distinct()
    drawn = hashed_share(ids, F.xxhash64("id", F.lit(1)), most)
    return _texts(docs, drawn.join(labels.select(F.col("doc_id").alias("id")), "id", "left_anti").withColumn("toxic", F.lit(-1)))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Scorer:
    small_batches(docs.sparkSession)
    labelled = checkpoint(training_rows(docs, labels, most))
    voters = mine(labelled)
    place = {v: i for i, v in enumerate(voters)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, n = hits(batch.column("text").to_pylist(), place)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array([c.astype("<u2").tobytes() for c in np.minimum(counts, 60000)], pa.binary())], ["toxic", "n", "counts"])

    both = labelled.union(unlabelled_rows(docs, labels, most)) if voters else labelled
    got = both.mapInArrow(run, "toxic int, n long, counts binary").toPandas().sort_values(["toxic", "n", "counts"])
    if not len(got):
        return Scorer([], np.zeros(0), np.array([-3.0, 0, 0, 0, 0]))
    counts = np.stack([np.frombuffer(c, "<u2") for c in got["counts"]]).astype(np.float64).reshape(len(got), len(voters))
    gold = got["toxic"].to_numpy(np.float64)
    votes = (counts > 0).astype(np.float64)
    model = fit_label_model(votes, gold)
    known = gold >= 0
    return Scorer(voters, model.weights, fit_linear(features(counts, got["n"].to_numpy(), model.weights)[known], model.posterior(votes, gold)[known]))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scorer.score(batch.column("text").fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents as they come, whatever their labels, are the unlabelled sample.
A linear classifier over the words a text holds is trained in numpy to the least of

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

R(+) and R(-) being mean logistic losses as if all were toxic or clean. The bracket is the risk of the clean documents,
estimated from the unlabelled ones less the toxic share; where training drives it below zero, which no true risk is,
the step goes back up instead. The prior is the share of toxic rows among the labels that may be used.

The classifier is fitted on bounded samples, ``POSITIVES`` and ``UNLABELLED`` rows at most, chosen by a hash of the id;
every document is scored, whole, in one narrow map. The model is a vector of ``DIMENSIONS`` floats.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import droppable, fold, occupy, unused

POSITIVES = 4_000
UNLABELLED = 16_000
BITS = 18
DIMENSIONS = 2**BITS
LEAST_POSITIVE = 3  # documents of the positives that a word must be in
THRESHOLD = 0.3
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    """The distinct words: runs of letters, digits and non-ASCII characters, lower-cased."""
    return set((text or "").lower().encode().translate(_BLANK).split())


def slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - BITS)


@dataclass(frozen=True)
class Model:
    """Log-odds of a text: ``bias`` and the weights of the slots of its words."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    prior: float

    def scorer(self):
        table = dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))
        of = table.get

        def score(text: str | None) -> float:
            # one sum for one set of words, whatever its order
            z = self.bias + sum(sorted(w for word in words(text) if (w := of(slot(word)))))
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 300, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """The classifier from the word slots of the sampled documents; without positives all scores are about ``prior``."""
    prior = min(max(prior, 1e-3), 0.5)
    base = math.log(prior / (1 - prior))
    if not positive or not unlabelled:
        return Model(base, np.zeros(0, np.int64), np.zeros(0), prior)
    count = lambda docs: np.bincount(np.concatenate(docs).astype(np.int64), minlength=DIMENSIONS)
    in_p, in_u = count(positive), count(unlabelled)
    rate_p, rate_u = (in_p + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(unlabelled) + 1)
    # words that set the positives apart from the rest by more than chance does
    z = (rate_p - rate_u) / np.sqrt(rate_u * (1 - rate_u).clip(1e-9) / len(positive))
    chosen = np.flatnonzero((in_p >= LEAST_POSITIVE) & (z > 6))
    place = np.full(DIMENSIONS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def rows(docs):
        sizes = [len(d) for d in docs]
        at = np.repeat(np.arange(len(docs)), sizes)
        cols = place[np.concatenate(docs).astype(np.int64)]
        return at[cols >= 0], cols[cols >= 0]

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(chosen)), base
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for t in range(1, rounds + 1):
        fp = b + np.bincount(pr, w[pc], len(positive))
        fu = b + np.bincount(ur, w[uc], len(unlabelled))
        up, uu = sigmoid(fp), sigmoid(fu)
        clean = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # derivatives by the margins: of l(f) is s(f) - 1, of l(-f) is s(f)
        dp, du = -prior * up / len(positive), uu / len(unlabelled)
        if clean < 0:
            gp, gu = -dp, -du
        else:
            gp, gu = dp + prior * (up - 1) / len(positive), du
        grad = np.append(np.bincount(pc, gp[pr], len(chosen)) + np.bincount(uc, gu[ur], len(chosen)) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), chosen, w, prior)


def _slots(docs: DataFrame, text: str, key: str, most: int) -> list[np.ndarray]:
    """The word slots of each document of a sample, made on the executors; ``most`` rows at most, the first by a hash."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        occupy(__name__)
        return pa.array([sorted({slot(w) for w in words(t)}) for t in texts.to_pylist()], pa.list_(pa.int32()))

    place = F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"))
    rows = docs.select(place.alias("place"), run(F.col(f"`{text}`")).alias("slots")).orderBy("place").limit(most).toArrow()
    return [np.asarray(x.values, np.int32) for x in rows["slots"] if len(x)]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The classifier, from the given labels only. Null keys and labels are ignored; a document with several labels is
    toxic if one of them says so. Without labels the prior is 0.5 per mille and all scores are alike. However often a key
    repeats, no more than twice ``POSITIVES`` and ``UNLABELLED`` rows reach the driver; ties of the hash that chooses
    them are equal rows."""
    k = unused(docs, "key")[0]
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(k)).agg(F.max((F.col(f"`{label}`") == 1).cast("int")).alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    toxic = toxic or 0
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(2**31))
    below = lambda most, all_: int(2**31 * min(1.0, most / max(1, all_)))
    ids = known.where("toxic = 1").where(place(F.col(k)) < below(POSITIVES, toxic)).select(k).limit(2 * POSITIVES)
    positive = docs.join(F.broadcast(ids), F.col(f"`{key}`") == F.col(k), "left_semi")
    rows = docs.count()
    unlabelled = docs.where(place(F.col(f"`{key}`")) < below(UNLABELLED, rows))
    return fit(_slots(positive, text, key, 2 * POSITIVES), _slots(unlabelled, text, key, 2 * UNLABELLED), toxic / n if n else 0.0005)


@lru_cache(maxsize=1)
def _scorer(raw: tuple) -> object:
    bias, slots, weights, prior = raw
    return Model(bias, np.frombuffer(slots, np.int64), np.frombuffer(weights, np.float64), prior).scorer()


droppable(__name__, _scorer.cache_clear)


def score(model: Model, text: Column) -> Column:
    """The probability, 0 to 1, that a text is toxic; null texts are empty, and empty texts have a score too."""
    raw = (model.bias, model.slots.astype(np.int64).tobytes(), model.weights.astype(np.float64).tobytes(), model.prior)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        occupy(__name__)
        return pa.array(map(_scorer(raw), texts.to_pylist()), pa.float64())

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of every row; the model learns from the labels of the other folds only.

    Rows that repeat a key are scored each; null keys, whose fold is unknown, are held out. Other columns are not read.
    An empty table gives no rows, empty labels give all rows one low score. A text is scored whole, however long.
    """
    held = lambda c: F.coalesce(fold(c) % 4 == 2, F.lit(True))
    model = train(docs.where(~held(F.col(f"`{key}`"))), labels.where(~held(F.col(f"`{key}`"))), text, key, label)
    rows = docs.select(F.col(f"`{key}`").alias(key), held(F.col(f"`{key}`")).alias("held_out"), score(model, F.col(f"`{text}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns, whatever these are called."""
    held = lambda c: F.coalesce(fold(c) % 4 == 2, F.lit(True))
    model = train(docs.where(~held(F.col(f"`{key}`"))), labels.where(~held(F.col(f"`{key}`"))), text, key, label)
    return docs.where(score(model, F.col(f"`{text}`")) < THRESHOLD)

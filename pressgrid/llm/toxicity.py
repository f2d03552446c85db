"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import fraction_filter

#: Places of the hashed feature space.
FEATURES = 1 << 22
#: A feature counts if this many of the fitted documents have it.
LEAST_DOCS = 6
#: After the fit, weights below this share of the largest are dropped, so that words never seen weigh nothing.
LEAST_WEIGHT = 0.4
#: Labelled documents of each kind that the model is fitted on at most, chosen by a hash of doc_id.
FIT_DOCS = 3000
#: Severity: 0 for no toxicity; a toxic document has 1, 2 or 3 by the number of telling words in it.
GRADES = 4
WORDS = re.compile(r"[^\W\d_]+")
KNOWN_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """Different words of the whole text, in lower case and in a fixed order."""
    return sorted(set(WORDS.findall((text or "").lower())))


def word_features(word: str) -> list[int]:
    """A word's hashed features: itself and its beginnings of 4, 5 and 6 letters."""
    parts = {f"w{word}", *(f"p{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in sorted(parts)]


def grade(labelled: list[tuple[list[str], int]], least_docs: int = 4, least_share: float = 0.8) -> np.ndarray:
    """Severity grades of ``(words, toxic)``: telling words are those in toxic documents nearly alone."""
    toxic, clean = Counter(), Counter()
    for words, label in labelled:
        (toxic if label else clean).update(words)
    telling = {w for w, n in toxic.items() if n >= least_docs and n >= least_share * (n + clean[w])}
    return np.array([min(GRADES - 1, max(1, len(telling.intersection(words)))) if label else 0 for words, label in labelled])


class OrdinalModel:
    """P(grade > j) = sigmoid(w.x - theta_j): one weight per feature for all thresholds, which are in order."""

    def __init__(self, weights: dict[int, float], thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def exceed(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))

    @staticmethod
    def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 30, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> OrdinalModel:
        """Likelihood ascent with AdaGrad over small batches, first over all features, then over those with a weight."""
        docs = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=FEATURES)
        rows = [r[docs[r] >= LEAST_DOCS] for r in rows]
        weights, _ = OrdinalModel._ascend(rows, grades, rounds, rate, decay, seed)
        kept = np.abs(weights) >= LEAST_WEIGHT * max(np.abs(weights).max(), 1e-9)
        rows = [r[kept[r]] for r in rows]
        weights, theta = OrdinalModel._ascend(rows, grades, rounds, rate, decay, seed)
        return OrdinalModel({int(i): float(weights[i]) for i in np.flatnonzero(kept)}, theta)

    @staticmethod
    def _ascend(rows: list[np.ndarray], grades: np.ndarray, rounds: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        levels = GRADES - 1
        weights, sums = np.zeros(FEATURES), np.full(FEATURES, 1e-6)
        theta, theta_sums = np.linspace(1.0, 3.0, levels), np.full(levels, 1e-6)
        flat = rows
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            order = rng.permutation(len(flat))
            for a in range(0, len(order), 64):
                pick = order[a:a + 64]
                idx = np.concatenate([flat[i] for i in pick]) if len(pick) else np.empty(0, np.int64)
                owner = np.repeat(np.arange(len(pick)), [len(flat[i]) for i in pick])
                score = np.bincount(owner, weights[idx], minlength=len(pick))
                # Bounds of each row's own grade on the cumulative curve; dP/dscore over P is the gradient.
                bounds = np.concatenate(([-np.inf], theta, [np.inf]))
                g = grades[pick]
                hi, lo = _sigmoid(bounds[g + 1] - score), _sigmoid(bounds[g] - score)
                p = np.maximum(hi - lo, 1e-9)
                dhi, dlo = hi * (1 - hi), lo * (1 - lo)
                dscore = (dhi - dlo) / p
                touched, inverse = np.unique(idx, return_inverse=True)
                grad = np.bincount(inverse, dscore[owner], minlength=len(touched)) / len(pick) + decay * weights[touched]
                sums[touched] += grad * grad
                weights[touched] -= rate * grad / np.sqrt(sums[touched])
                dtheta = np.zeros(levels)
                for j in range(levels):
                    dtheta[j] = (np.sum(-dhi[g == j] / p[g == j]) + np.sum(dlo[g == j + 1] / p[g == j + 1])) / len(pick)
                theta_sums += dtheta * dtheta
                theta = np.sort(theta - rate * dtheta / np.sqrt(theta_sums))
        return weights, theta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words_of(x)) for x in batch.column(1).to_pylist()], pa.string())], names=["toxic", "words"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> OrdinalModel | None:
    """Fits on at most about ``fit_docs`` toxic and twice as many other labelled documents; None without both kinds.

    ``labels(doc_id, toxic)``; null labels are left out, of several labels of a document the highest counts.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}  # a row per label
    if not counts.get(1) or not counts.get(0):
        return None
    key = F.col("doc_id")
    kept = marks.filter(F.when(F.col("toxic") == 1, fraction_filter(key, fit_docs / counts[1])).otherwise(fraction_filter(key, 2 * fit_docs / counts[0])))
    # The kept labels are few by the bound above.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(kept), "doc_id").select("toxic", "text")
    sample = [(r["words"].split(" ") if r["words"] else [], r["toxic"]) for r in rows.mapInArrow(_words, "toxic int, words string").toLocalIterator()]
    sample.sort()
    if not any(t for _, t in sample) or all(t for _, t in sample):
        return None
    known: dict[str, list[int]] = {}
    features = []
    for words, _ in sample:
        known.update((w, word_features(w)) for w in words if w not in known)
        features.append(np.array([f for w in words for f in known[w]], np.int32))
    return OrdinalModel.fit(features, grade(sample))


def _score(model: OrdinalModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}

        def weight(word: str) -> float:
            found = known.get(word)
            if found is None:
                found = sum(model.weights.get(f, 0.0) for f in word_features(word))
                if len(known) < KNOWN_WORDS:
                    known[word] = found
            return found

        for batch in batches:
            texts = batch.column(1).to_pylist()
            if model is None:
                expected, top = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            else:
                above = model.exceed(np.array([sum(map(weight, words_of(x))) for x in texts]))
                expected = above.sum(axis=1)
                shares = -np.diff(np.column_stack([np.ones(len(texts)), above, np.zeros(len(texts))]), axis=1)
                top = shares.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top, pa.int32()), pa.array(np.round(expected, 6))], names=["doc_id", "severity", "expected_severity"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, threshold: float = 0.5) -> DataFrame:
    """Severity of every row of ``docs(doc_id, text)``: ``doc_id, severity, expected_severity, toxic``.

    severity is the likeliest grade of 0 to 3, expected_severity the mean grade, and a document is toxic where
    that mean reaches ``threshold``.  Null, empty and wordless texts have the score 0 of no feature.  Without
    labels of both kinds every severity is 0.  Rows that repeat are graded each.  An empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, fit_docs)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    graded = texts.mapInArrow(_score(model), "doc_id bigint, severity int, expected_severity double")
    return graded.withColumn("toxic", F.col("expected_severity") >= threshold)

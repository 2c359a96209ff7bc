"""Repetition inside a document (problem 10).

A logistic regression over hashed word and character n-grams, weighted by how often they come back in the text, is fitted on labelled
rows, calibrated on others, and scored over all texts in Arrow batches against a fixed threshold. Only documents above it are then
measured exactly: the share of words that stand in a run of four or more words given earlier in the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 4
BUCKETS = 64
_OTHER = regex.compile(r"[^\p{L}\s]+")


def words_of(text: str | None) -> list[str]:
    """Words in small letters, without punctuation and digits; none for a null or empty text."""
    return _OTHER.sub("", text.lower()).split() if text else []


def repeated_share(words: list[str], run: int = RUN) -> float:
    """The share of words that stand in a run of at least run words already given earlier in the text; 0 for a text without words."""
    first: set[tuple[str, ...]] = set()
    marked, upto = 0, 0
    for i in range(len(words) - run + 1):
        gram = tuple(words[i : i + run])
        if gram in first:
            marked += i + run - max(i, upto)
            upto = i + run
        else:
            first.add(gram)
    return marked / len(words) if words else 0.0


def features(words: list[str]) -> np.ndarray:
    """Hashed n-grams that come back: for word 1-, 2- and 4-grams and character 12-grams, what share of the text each bucket repeats."""
    out = np.zeros((4, BUCKETS), np.float32)
    if not words:
        return out.ravel()
    # by content, as a bucket must mean the same in every text
    ids = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    text = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        two = _joined(_spread(ids), 1)
        four = _joined(_joined(_spread(text), 1), 2)
        for row, h in enumerate((_spread(ids), two, _joined(two, 2), _joined(_joined(four, 4)[: max(0, len(text) - 11)], 8, four))):
            if len(h):
                h.sort()
                again = h[1:][h[1:] == h[:-1]]  # each occurrence but one of an n-gram
                out[row] = np.bincount((again >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS) / len(h)
    return out.ravel()


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _joined(h: np.ndarray, by: int, more: np.ndarray | None = None) -> np.ndarray:
    """Hashes of n-grams of both: of each n-gram of h and of the one of more (or h) that begins by places further on."""
    other = (h if more is None else more)[by:]
    n = min(len(h), len(other))
    return _spread(h[:n] * np.uint64(0x9E3779B97F4A7C15) + other[:n])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.shift, -50, 50)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float | np.ndarray) -> np.ndarray:
    penalty = np.append(np.broadcast_to(ridge, x.shape[1]), 1e-6)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    loss = lambda v: float((np.logaddexp(0, x @ v) - y * (x @ v)).sum() + (penalty * v * v).sum() / 2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step, scale = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w), 1.0
        while scale > 1e-6 and loss(w + scale * step) > loss(w):
            scale /= 2
        w += scale * step
        if np.abs(scale * step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression on two thirds of the rows and Platt's calibration on the others. Where only one class is given, the summed
    share of repeated words decides."""
    held = np.arange(len(x)) % 3 == 2
    if len(x) < 30 or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        weights = np.zeros(4 * BUCKETS)
        weights[2 * BUCKETS : 3 * BUCKETS] = 40.0
        return Model(weights, -8.0, 1.0, 0.0)
    # the same weight for every bucket of a kind is the prior: the four sums are fitted with the buckets' own part around them, held by a ridge
    sums = x.reshape(len(x), 4, BUCKETS).sum(axis=2)
    both = _newton(np.hstack([sums, x])[~held], y[~held], np.repeat([1e-3, 1.0], [4, 4 * BUCKETS]))
    weights, bias = np.repeat(both[:4], BUCKETS) + both[4:-1], both[-1]
    platt = _newton((x[held] @ weights + bias)[:, None], y[held], 1e-3)
    return Model(weights, float(bias), float(platt[0]), float(platt[1]))


def train(documents: DataFrame, share: float, rows: int) -> Model:
    """Fitted on at most rows documents, those with the smallest hash of their id; the label is whether the repeated share reaches share."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) for t in b.text]
            yield pd.DataFrame({"x": [features(w).tolist() for w in words], "y": [float(repeated_share(w) >= share) for w in words]})

    # only ids are ordered; the texts of the few chosen are fetched then
    chosen = documents.filter("text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").filter("text is not null")
    got = sample.mapInPandas(measured, "x array<float>, y double").toPandas()
    if got.empty:
        return fit(np.zeros((0, 4 * BUCKETS)), np.zeros(0))
    return fit(np.array(got.x.tolist(), np.float64), got.y.to_numpy())


def scores(documents: DataFrame, model: Model, above: float | None = None) -> DataFrame:
    """(doc_id, n_words, repeated_share, score): the model's score of every document and its share of repeated words, measured exactly.

    above: only documents that score as much are measured and come out. Documents go through in Arrow batches without a shuffle; only the
    model (some hundred numbers) is sent to the tasks.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) for t in b.text]
            score = model.score(np.stack([features(w) for w in words]) if words else np.zeros((0, 4 * BUCKETS), np.float32))
            at = np.flatnonzero(score >= above) if above is not None else np.arange(len(b))
            yield pd.DataFrame({"doc_id": b.doc_id.to_numpy()[at], "n_words": [len(words[i]) for i in at], "repeated_share": [repeated_share(words[i]) for i in at], "score": score[at]})

    return documents.select("doc_id", "text").mapInPandas(scored, "doc_id bigint, n_words bigint, repeated_share double, score double")


def repetition(documents: DataFrame, share: float = 0.3, sample_rows: int = 3000) -> DataFrame:
    """(doc_id, n_words, repeated_share, score): for every document its share of repeated words and the calibrated probability that it is repetitive.

    Whole texts are measured. Null, empty and wordless texts have share 0. Equal ids give a row each.
    """
    return scores(documents, train(documents, share, sample_rows))


def repetitive(documents: DataFrame, share: float = 0.3, threshold: float = 0.005, sample_rows: int = 3000) -> DataFrame:
    """(doc_id): the distinct documents whose score reaches threshold and whose repeated share, measured exactly, reaches share."""
    found = scores(documents, train(documents, share, sample_rows), threshold)
    return found.filter(F.col("repeated_share") >= share - 1e-12).select("doc_id").distinct()

"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: words, character trigrams of words with their edges
(on UTF-8 bytes), and word bigrams, hashed into one table; a bigram of equal words is hashed as such, whatever the word. A linear layer and softmax give
the class. Vectors and layer are trained together by stochastic gradient descent in numpy, one document a step.

Averaging and the layer are linear, so for scoring every row of the table is reduced to one number beforehand.
Texts are whole; null and empty texts have no features and get the score of the bias alone. Without labelled rows
(or with one class only) the model is the share of label 1 among them, or one half.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.classify import gather, labelled_sample, score_rows, sigmoid
from inkwell.llm.common import WHITE, Words, mix, remainder, table

#: Documents that the model is fitted on, at most.
MAX_TRAIN = 3000
BUCKETS = 1 << 16
DIM = 8
EPOCHS = 6
RATE = 0.3
_SAME = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of all texts, and the text of each."""
    words = Words(texts)
    h = words.hashes()
    doc = np.repeat(np.arange(len(texts)), np.diff(words.at))
    same, within = h[:-1] == h[1:], doc[:-1] == doc[1:]
    pair = (np.where(same, _SAME, mix(h[:-1] * np.uint64(31) + h[1:])) % np.uint64(BUCKETS))[within]
    # White space of any kind and length is one space at a word's edge.
    c = np.where(WHITE[words.raw], 32, words.raw).astype(np.uint32)
    at = np.flatnonzero(c != 32)
    code = c[at - 1] | c[at] << np.uint32(8) | c[at + 1] << np.uint32(16)
    gram = (code * np.uint32(2654435761)) >> np.uint32(16)
    line = np.repeat(doc, words.end - words.start)
    return np.concatenate([(h % np.uint64(BUCKETS)).astype(np.int64), pair.astype(np.int64), gram.astype(np.int64)]), np.concatenate([doc, doc[:-1][within], line])


def fit(y: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's number and the bias: a document's log odds are their mean over its features, plus the bias."""
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    use = [k for k in range(len(y)) if len(docs[k][0])]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(use):
            f, n = docs[k]
            part = n / n.sum()
            mean = part @ vectors[f]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # A row's gradient holds its share of the average; scaled as if every feature were one of few.
            vectors[f] -= (step * min(len(f), 50)) * part[:, None] * back[None, :]
    toward = layer[:, 1] - layer[:, 0]
    return (vectors @ toward).astype(np.float64), float(bias[1] - bias[0])


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        f, doc = features(texts)
        n = np.bincount(doc, minlength=len(texts))
        total = np.bincount(doc, self.weights[f], minlength=len(texts))
        return sigmoid(total / np.maximum(n, 1) + self.bias)


@lru_cache(maxsize=1)
def _scorer(weights: bytes, bias: float) -> Scorer:
    return Scorer(np.frombuffer(weights, np.float32).astype(np.float64), bias)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", max_train: int = MAX_TRAIN, rows: DataFrame | None = None, **how) -> DataFrame:
    """(key, score) for each row: the probability of quality 1. Fits on at most max_train labelled documents, on the driver.

    With rows (row, text) it scores these instead, as (row, score).
    """
    weights, bias = fit(*gather(labelled_sample(docs, labels, "quality", max_train, key), lambda x: features([x])[0]), **how)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).tobytes())
    scored, by = (docs, key) if rows is None else (rows, "row")
    return score_rows(scored, lambda data: _scorer(shared.value, bias)(data), by)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

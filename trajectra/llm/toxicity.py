"""Toxicity by a classifier chain.

Categories stand in an order.  Each has a sparse linear model over hashed word and
word-start features; the models of later categories also see the probabilities of
all earlier ones.  While training, those come from models of other folds, so a
later model learns from probabilities as uncertain as it will meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import prepare

SAMPLE_ROWS = 6_000          # labelled rows that a fit reads at most, half of them with the last category
BITS = 18                    # hashed features
STARTS = (4, 5)              # characters of the word starts
FOLDS = 3
EPOCHS = 8
THRESHOLD = 0.3

_words = re.compile(r"[^\W\d_]+").findall


class Features(dict):
    """Word -> numbers of its features, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 500_000:
            self.clear()
        names = [word] + [f"{word[:n]}~" for n in STARTS if len(word) > n]
        out = self[word] = tuple(xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in names)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Distinct features of a whole text."""
        words = set(_words(text.lower())) if text else ()
        return np.fromiter(set(chain.from_iterable(map(self.__getitem__, words))), dtype=np.int64)


class Linear:
    """Logistic model with sparse weights, fitted by follow-the-regularised-leader steps."""

    def __init__(self, extra: int, alpha: float = 0.3, l1: float = 1.0, l2: float = 1.0):
        self.size = (1 << BITS) + extra + 1
        self.alpha, self.l1, self.l2 = alpha, l1, l2
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)
        self.w: np.ndarray | None = None

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((1.0 + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def _row(self, features: np.ndarray, earlier) -> tuple[np.ndarray, np.ndarray]:
        extra = np.asarray(earlier, dtype=np.float64)
        at = np.concatenate([features, np.arange((1 << BITS), self.size)])
        return at, np.concatenate([np.ones(len(features)), _logit(extra), [1.0]])

    def fit(self, rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> "Linear":
        ready = [self._row(f, e) for f, e in zip(rows, earlier)]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(ready)):
                at, x = ready[i]
                w = self._weights(at)
                g = (_sigmoid(w @ x) - y[i]) * x
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        self.w = self._weights(np.arange(self.size))
        self.z = self.n = None
        return self

    def predict(self, features: np.ndarray, earlier) -> float:
        extra = _logit(np.asarray(earlier, dtype=np.float64)) @ self.w[(1 << BITS):-1] if len(earlier) else 0.0
        return float(_sigmoid(self.w[features].sum() + extra + self.w[-1]))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1.0 - 1e-3)
    return np.log(p / (1.0 - p)) / 4.0


class Chain:
    def __init__(self, categories: list[str], models: list[Linear]):
        self.categories, self.models = categories, models

    def predict(self, features: np.ndarray) -> list[float]:
        out: list[float] = []
        for m in self.models:
            out.append(m.predict(features, out))
        return out


def fit_chain(texts: list[str], labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """A chain over ``labels`` (category -> 0/1 per text), in their order.

    Without texts every probability is 0.5; a category without positive texts
    gets a low probability everywhere.
    """
    make = Features()
    rows = [make.of(t) for t in texts]
    fold = np.arange(len(rows)) % folds
    earlier = np.empty((len(rows), 0))
    models = []
    for y in labels.values():
        y = np.asarray(y, dtype=np.float64)
        held = np.zeros(len(rows))
        for f in range(folds):                                # out-of-fold probabilities for the later models
            rest = np.flatnonzero(fold != f)
            m = Linear(earlier.shape[1]).fit([rows[i] for i in rest], earlier[rest], y[rest])
            for i in np.flatnonzero(fold == f):
                held[i] = m.predict(rows[i], earlier[i])
        models.append(Linear(earlier.shape[1]).fit(rows, earlier, y))
        earlier = np.column_stack([earlier, held])
    return Chain(list(labels), models)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on at most ``sample_rows`` labelled rows, half of them at most with the last category.

    ``categories`` names each category and its SQL condition over ``labels``, in
    chain order.  The sample is the rows with the smallest hash of doc_id.  Rows
    with a null doc_id or a null condition are not used; a doc_id with several
    texts or labels gives its smallest text and labels.
    """
    names = [f"c{i}" for i in range(len(categories))]
    known = labels.select("doc_id", *[F.expr(e).cast("int").alias(n) for n, e in zip(names, categories.values())]).na.drop()
    known = known.withColumn("h", F.xxhash64("doc_id"))
    half = sample_rows // 2
    picked = known.filter(F.col(names[-1]) == 1).orderBy("h", *names).limit(half).unionByName(
        known.filter(F.col(names[-1]) == 0).orderBy("h", *names).limit(sample_rows - half))
    rows = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(picked), "doc_id")     # bounded by sample_rows
    rows = rows.groupBy("h").agg(F.min(F.struct("t", *names)).alias("r")).select("h", "r.*").orderBy("h").collect()
    return fit_chain([r["t"] or "" for r in rows], {c: np.array([r[n] for r in rows]) for c, n in zip(categories, names)})


def _predict_udf(shared):
    @F.pandas_udf("array<double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        make, model = Features(), shared.value
        for texts in batches:
            yield pd.Series([model.predict(make.of(t)) for t in texts], dtype="object")
    return predict


def predict(docs: DataFrame, model: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with an array ``into``: the probability of each category, from whole texts.

    Null texts score as empty ones, repeated rows alike.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, _predict_udf(shared)(F.col(text)))


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, str], threshold: float = THRESHOLD,
             **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, a probability p_<category> of each, and toxic (the last one's verdict, 0 or 1)."""
    out = predict(docs.select("doc_id", "text"), fit(docs, labels, categories, **options))
    scores = [F.get("toxicity", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(categories)]
    return out.select("doc_id", *scores, (F.get("toxicity", F.lit(len(categories) - 1)) >= threshold).cast("int").alias("toxic"))

"""Quality classifier by compression with class dictionaries.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts.  A text that compresses better with the good dictionary than with the bad
one resembles the good class: the difference of the two sizes, divided by the
text's size, is the raw score, and a logistic curve through the labelled rows
turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import prepare

SAMPLE_ROWS = 4_000          # labelled rows of each class that a fit reads at most
PIECE = 2_000                # bytes of one dictionary training sample; every text is cut into such pieces
FOLDS = 4
DICT_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


def sizes(texts, compressors) -> np.ndarray:
    """Compressed sizes of each text with each dictionary, and its own size."""
    out = np.empty((len(texts), len(compressors) + 1))
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        out[i, -1] = len(b)
        for j, c in enumerate(compressors):
            out[i, j] = len(c.compress(b))
    return out


def features(s: np.ndarray) -> np.ndarray:
    """Normalised size difference (bad minus good), and both compression ratios."""
    n = s[:, 2] + 20.0
    return np.column_stack([(s[:, 1] - s[:, 0]) / n, s[:, 0] / n, s[:, 1] / n, 100.0 / (100.0 + s[:, 2]),
                            (s[:, 1] - s[:, 0]) / (s[:, 0] + s[:, 1] + 1.0)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple:
    """Newton steps for a ridge logistic curve over standardised columns."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), ridge * len(x))
    keep[0] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + keep * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(keep)
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return mean, scale, w


def _expand(f: np.ndarray) -> np.ndarray:
    return np.column_stack([f] + [f[:, i] * f[:, j] for i in range(f.shape[1]) for j in range(i, f.shape[1])])


class Model:
    def __init__(self, dicts: list[bytes], curve: tuple, prior: float):
        self.dicts, self.curve, self.prior = dicts, curve, prior

    def compressors(self) -> list:
        out = []
        for d in self.dicts:
            ready = zstd.ZstdCompressionDict(d) if d else None
            if ready:
                ready.precompute_compress(level=LEVEL)
            out.append(zstd.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, dict_data=ready))
        return out

    def score(self, texts, compressors) -> np.ndarray:
        s = sizes(texts, compressors)
        if self.curve is None:
            return np.full(len(s), self.prior)
        mean, scale, w = self.curve
        z = (_expand(features(s)) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(w[0] + z @ w[1:], -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on give a raw one of their own bytes."""
    try:
        return zstd.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:]


def _dictionaries(good: list[str], bad: list[str]) -> list[bytes]:
    return [_dictionary([b[i:i + PIECE] for b in (t.encode("utf-8", "surrogatepass") for t in texts)
                         for i in range(0, len(b), PIECE)]) for texts in (good, bad)]


def fit_sample(good: list[str], bad: list[str], folds: int = FOLDS) -> Model:
    """Dictionaries from all texts; the curve from sizes under dictionaries that have not seen the text.

    Too few texts of a class make all scores the share of good rows (0.5 if there
    are none at all).
    """
    prior = (len(good) + 0.5) / (len(good) + len(bad) + 1)
    if min(len(good), len(bad)) < folds:
        return Model([b"", b""], None, prior)
    x, y = [], []
    for f in range(folds):
        rest = [[t for i, t in enumerate(ts) if i % folds != f] for ts in (good, bad)]
        fold = Model(_dictionaries(*rest), None, prior).compressors()
        for ts, label in ((good, 1.0), (bad, 0.0)):
            x.append(features(sizes(ts[f::folds], fold)))
            y.append(np.full(len(x[-1]), label))
    return Model(_dictionaries(good, bad), logistic(_expand(np.concatenate(x)), np.concatenate(y)), prior)


def held_out(doc_id):
    """True for one doc_id in five, by crc32 of its decimal text; null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` rows of each class of the labelled rows that are not held out.

    The sample is the rows with the smallest hash of doc_id, so reruns agree.
    Rows with a null label or doc_id are not used; a doc_id with several texts
    gives its smallest text.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        "y IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).distinct()
    known = known.withColumn("h", F.xxhash64("doc_id"))
    picked = known.filter("y = 1").orderBy("h").limit(sample_rows).unionByName(
        known.filter("y = 0").orderBy("h").limit(sample_rows))
    # at most 2 * sample_rows rows, so the broadcast and the collected texts are bounded
    rows = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("y", "h").agg(F.min("t").alias("t")).orderBy("h", "y").collect()
    return fit_sample([r["t"] or "" for r in rows if r["y"] == 1], [r["t"] or "" for r in rows if r["y"] == 0])


def _score_udf(shared):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compressors = shared.value.compressors()
        for texts in batches:
            yield pd.Series(shared.value.score(texts, compressors), dtype="float64")
    return score


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability that a text is good, from its whole text alone.

    Null texts score as empty ones.  Repeated rows score alike.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(into, _score_udf(shared)(F.col(text)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns.

    Null texts are scored as empty ones; repeated rows stay or go together; null
    doc_ids have no label and are scored like others.  An empty table gives an empty
    result.  Columns of any name are kept.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    out = score(rows, fit(docs, labels, **options), "_text", "_score")
    return out.filter(F.col("_score") >= threshold).select("_row.*")

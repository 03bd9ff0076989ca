"""Quality rules of documents, with verdicts on their hosts.

Every document is measured and judged by the base rules.  Failures are counted by
host; a host's failure rate is shrunk towards the corpus by a beta prior fitted to
all hosts' counts, so a host with few documents is not condemned by them.  Hosts
whose shrunk rate is too high lose all their documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import attach, prepare, staged

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5          # a host with a higher shrunk failure rate loses its documents
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the list holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], dtype=np.int64, count=n)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1] if len(number) > 1_000_000 else \
        ids[:-1] * len(number) + ids[1:]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = often.copy()
    inside[1:] |= often[:-1]
    inside[2:] |= often[:-2]
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()       # bytes are split at exactly the six ASCII spaces
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts],
                        columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def host_verdicts(judged: DataFrame, host: str, failed: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: n_docs, n_failed, rate (shrunk), host_failed.

    The prior's mean is the failure rate of all documents; its strength comes from
    the intraclass correlation of the hosts' counts (moment estimate, kept within
    1e-6 and 1).  One host alone is shrunk almost wholly to the mean, which is its own.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum(F.when(failed, 1).otherwise(0)).alias("n_failed"))
    n, x = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    # sums of n (p - mean)^2 come from three plain sums; one row in all
    sums = hosts.agg(F.sum("n_docs").alias("_n"), F.sum("n_failed").alias("_x"), F.sum(n * n).alias("_nn"),
                     F.sum(x * x / n).alias("_xx"), F.count(F.lit(1)).alias("_k"))
    mean = F.col("_x") / F.col("_n")
    spread = mean * (1 - mean)
    between = F.col("_xx") - F.col("_n") * mean * mean - (F.col("_k") - 1) * spread
    most = spread * (F.col("_n") - F.col("_nn") / F.col("_n") - (F.col("_k") - 1))
    like = F.least(F.greatest(F.coalesce(F.when(most > 0, between / most), F.lit(0.0)), F.lit(1e-6)), F.lit(1.0))
    prior = sums.select(mean.alias("_mean"), (1 / like - 1).alias("_strength"))
    out = hosts.crossJoin(F.broadcast(prior))                  # one row
    rate = (F.col("n_failed") + F.col("_mean") * F.col("_strength")) / (F.col("n_docs") + F.col("_strength"))
    return out.withColumn("rate", rate).select(host, "n_docs", "n_failed", "rate", (F.col("rate") > max_rate).alias("host_failed"))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, host column) with its measures and verdicts.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 50 words, or more than half of them in repeated
    three-word windows), host_rate, host_failed, kept (neither failed).

    Null and empty texts have no words and fail.  Documents with a null host make
    one host of their own.  Repeated rows count as documents of their own.  An
    empty table gives an empty result.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    key = F.when(F.col(host).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(host).cast("string")))
    rows = docs.select("doc_id", key.alias("_host"), F.pandas_udf(_measures, MEASURES)(F.col("text")).alias("m"))
    rows = staged(rows.select("doc_id", "_host", "m.*"), "measures")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    hosts = host_verdicts(rows, "_host", F.col("base_failed"), max_rate)
    out = attach(rows, hosts, "_host", "n_docs", rows.count(), F.xxhash64("doc_id", F.monotonically_increasing_id()))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.col("rate").alias("host_rate"), "host_failed",
                      (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))

"""Benchmark decontamination by a prefix-filtered set join.

Benchmark items become windows of ``WINDOW`` consecutive words (shorter items one
window).  A window can only occur in a document that holds all its shingles, so
it is enough to join on one of them, and the rarest in the corpus makes the
fewest candidates.  A candidate fixes where the window would have to start; it
must fit into the document (position and length bounds) and is then compared word
by word over the whole window.

The windows are the bounded side: they are taken in blocks of at most
``BLOCK_WINDOWS``, each broadcast by itself; documents stay where they are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import prepare, staged

WINDOW = 13
SHINGLE = 3                   # words of a prefix shingle (fewer for windows that are shorter)
BLOCK_WINDOWS = 500_000       # windows in one broadcast: about 30 MB
MATCH = "n_words long, hits binary, items array<string>"

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall     # the contract's words, on lower-cased UTF-8


def words_of(text: str | None) -> list[bytes]:
    return [] if not text else _words(text.encode("utf-8", "surrogatepass").lower())


class Windows:
    """Distinct windows of some items, as rows of word numbers, and their prefix shingles."""

    def __init__(self, windows: dict[tuple, list[str]]):
        self.vocab: dict[bytes, int] = {}
        number = self.vocab.setdefault
        self.items = list(windows.values())
        rows = [[number(w, len(self.vocab)) for w in words] for words in windows]
        # shorter rows are filled with -2, which is no word number
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        width = max((len(r) for r in rows), default=1)
        self.rows = np.full((len(rows), width), -2, dtype=np.int32)
        for i, r in enumerate(rows):
            self.rows[i, :len(r)] = r
        self.sizes = sorted({min(SHINGLE, n) for n in self.lengths.tolist()})

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        """Code of the ``size`` words from each position, -1 where a word is not in any window."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        code, ok = ids[:n].astype(np.int64), ids[:n] >= 0
        for j in range(1, size):
            code = code * len(self.vocab) + ids[j:j + n]
            ok &= ids[j:j + n] >= 0
        return np.where(ok, code, -1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocab.get
        return np.fromiter([get(w, -1) for w in words], dtype=np.int32, count=len(words))

    def known(self) -> dict[int, np.ndarray]:
        """All shingle codes of the windows, by shingle size, sorted."""
        return {s: np.unique(np.concatenate([self.shingles(r[:n], s) for r, n in zip(self.rows, self.lengths)
                                             if min(SHINGLE, n) == s])) for s in self.sizes}

    def index(self, frequency: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle; ties go to the first."""
        known = self.known()
        picks: dict[int, list] = {s: [] for s in self.sizes}
        for i, (r, n) in enumerate(zip(self.rows, self.lengths)):
            s = min(SHINGLE, int(n))
            codes = self.shingles(r[:n], s)
            at = int(np.argmin(frequency[s][np.searchsorted(known[s], codes)]))
            picks[s].append((int(codes[at]), at, i))
        self.prefix = {}
        for s, found in picks.items():
            found.sort()
            a = np.array(found, dtype=np.int64).reshape(-1, 3)
            codes, first, count = np.unique(a[:, 0], return_index=True, return_counts=True)
            self.prefix[s] = (codes, first, count, a[:, 1], a[:, 2])

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Positions inside any occurrence of a window, and the windows that occur."""
        ids = self.ids(words)
        hit, found = np.zeros(len(ids) + 1, dtype=np.int64), set()
        for s in self.sizes:
            codes, first, count, offset, window = self.prefix[s]
            here = self.shingles(ids, s)
            if not len(here) or not len(codes):
                continue
            at = np.searchsorted(codes, here)
            at[at == len(codes)] = 0
            pos = np.flatnonzero(codes[at] == here)
            if not len(pos):
                continue
            k = at[pos]
            which = np.repeat(first[k] - np.concatenate(([0], np.cumsum(count[k])[:-1])), count[k]) + np.arange(count[k].sum())
            start, win = np.repeat(pos, count[k]) - offset[which], window[which]
            length = self.lengths[win]
            fits = (start >= 0) & (start + length <= len(ids))                 # position and length bounds
            start, win, length = start[fits], win[fits], length[fits]
            same = np.ones(len(start), dtype=bool)
            for j in range(self.rows.shape[1]):                                # exact, word by word
                inside = j < length
                same &= ~inside | (ids[np.minimum(start + j, len(ids) - 1)] == self.rows[win, j])
            start, win, length = start[same], win[same], length[same]
            np.add.at(hit, start, 1)
            np.add.at(hit, start + length, -1)
            found.update(win.tolist())
        return np.cumsum(hit[:-1]) > 0, found


def _frequency_pass(shared, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        known = windows.known()
        sums = {s: np.zeros(len(c) + 1, dtype=np.int64) for s, c in known.items()}
        for pdf in batches:
            for text in pdf[column]:
                ids = windows.ids(words_of(text))
                for s, codes in known.items():
                    here = windows.shingles(ids, s)
                    here = here[here >= 0]
                    if len(here):
                        at = np.searchsorted(codes, here)
                        at[at == len(codes)] = 0
                        at = np.unique(at[codes[at] == here])
                        sums[s][at] += 1
        for s, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"size": pd.array([s] * len(at), "int32"), "shingle": at, "n": n[at]})
    return run


def _match_udf(shared, earlier: bool):
    def first(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_matched(shared.value, t) for t in texts], columns=["n_words", "hits", "items"])

    def further(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_matched(shared.value, t, h, k) for t, h, k in zip(texts, before["hits"], before["items"])],
                            columns=["n_words", "hits", "items"])

    return F.pandas_udf(further if earlier else first, MATCH)


def _matched(windows: Windows, text: str | None, hits: bytes | None = None, items=()) -> tuple:
    """Words, packed hits and items of a text, with what earlier blocks found."""
    words = words_of(text)
    hit, found = windows.match(words)
    if hits is not None:
        hit = hit | np.unpackbits(np.frombuffer(hits, dtype=np.uint8), count=len(words)).astype(bool)
    return len(words), np.packbits(hit).tobytes(), sorted({k for w in found for k in windows.items[w]} | set(items))


def _summary(m: pd.DataFrame) -> pd.DataFrame:
    hits = [int(np.unpackbits(np.frombuffer(h, dtype=np.uint8), count=n).sum()) for h, n in zip(m["hits"], m["n_words"])]
    out = pd.DataFrame({"n_words": m["n_words"], "n_hit": hits, "n_items": [len(x) for x in m["items"]]})
    out["items_sha256"] = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in m["items"]]
    out["contaminated"] = (out["n_hit"] > 0) & (20 * out["n_hit"] >= out["n_words"])
    return out


SUMMARY = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _blocks(items: DataFrame, block_windows: int, window: int) -> Iterator[dict[tuple, list[str]]]:
    """Distinct windows with their items, in blocks of bounded size.

    The driver streams the items one partition at a time and holds one block.
    """
    block: dict[tuple, list[str]] = {}
    rows = items.select(F.col("item_id").cast("string").alias("k"), F.col("text").alias("t")).filter(
        "k IS NOT NULL AND t IS NOT NULL").orderBy("k").toLocalIterator()
    for r in rows:
        words = words_of(r["t"])
        for i in range(max(1, len(words) - window + 1) if words else 0):
            ids = block.setdefault(tuple(words[i:i + window]), [])
            if r["k"] not in ids:
                ids.append(r["k"])
            if len(block) >= block_windows:
                yield block
                block = {}
    yield block


def mark_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                       block_windows: int = BLOCK_WINDOWS, text: str = "text", into: str = "match") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a window of an item.
    contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts have
    no words and are clean; items with a null id or text have no windows; an item
    given twice counts once; repeated documents are marked each by itself.  Empty
    tables give an empty or all-clean result.  All columns of ``docs`` are kept;
    only one named ``into`` is replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    marked, earlier = docs, False
    for block in _blocks(items, block_windows, window):
        windows = Windows(block)
        shared = spark.sparkContext.broadcast(windows)
        counted = docs.select(F.col(text).alias("_t")).mapInPandas(
            _frequency_pass(shared, "_t"), "size int, shingle long, n long") \
            .groupBy("size", "shingle").agg(F.sum("n").alias("n"))
        known = windows.known()
        frequency = {s: np.zeros(len(c), dtype=np.int64) for s, c in known.items()}
        for s, k, n in (counted.collect() if known else []):     # at most one number per shingle of the block
            frequency[s][k] = n
        windows.index(frequency)
        shared = spark.sparkContext.broadcast(windows)
        if earlier:
            marked = staged(marked, "decontaminate")
        cols: list[Column] = [F.col(text)] + ([F.col(into)] if earlier else [])
        marked = marked.withColumn(into, _match_udf(shared, earlier)(*cols))
        earlier = True
    return marked.withColumn(into, F.pandas_udf(_summary, SUMMARY)(F.col(into)))


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return mark_contamination(docs.select("doc_id", "text"), items, **options).select("doc_id", "match.*")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The clean rows of ``docs`` with their columns.

    Null and empty texts have no words, so they are clean; repeated rows stay or go
    together; null doc_ids are kept.  Without items every row is clean.  An empty table gives
    an empty result.  Columns of any name are kept.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text"))
    return mark_contamination(rows, items, **options).filter("NOT match.contaminated").select("_row.*")

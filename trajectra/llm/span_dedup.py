"""Substring deduplication over sliding spans of sentences.

Every run of several consecutive sentences is hashed: from each sentence on, and
up to each sentence, the shortest run of at least ``MIN_SENTENCES`` sentences and
``MIN_WORDS`` words (or of any number of sentences with ``LONG_WORDS`` words, so
that a passage of one or two long sentences counts).  Hashes are joined over all
documents; a run's first place is the smallest doc_id, and within a document the
first sentence.  Sentences covered by a run at any other place are removed.

Sentences of more than ``PIECE`` words are cut into pieces of at most so many, at
words that the words around them determine.  Of a passage that begins and ends
inside sentences no more than ``PIECE`` words at each end are in other pieces than
in its copies, so any 51 repeated words hold a complete run of 25.  Repeats inside
one document are looked for in whole sentences and clauses.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import drop_staged, prepare, staged, text_key

MIN_SENTENCES = 2
MIN_WORDS = 25
LONG_WORDS = 50
LONG_SENTENCE = 20
PIECE = (LONG_WORDS + 1 - MIN_WORDS) // 2
RUNS = "hi array<long>, lo array<int>, first array<int>, size array<int>, own array<int>"

_breaks = re.compile(r"[.!?。！？][ \t\x0b\x0c\r\n]+|\n[ \t\x0b\x0c\r\n]*").finditer
_clauses = re.compile(r"[,;:][ \t]+").finditer
_SPACE = " \t\n\r\x0b\x0c"
_words = re.compile(f"[^{_SPACE}]+[{_SPACE}]*").findall          # words, each with the space behind it


class PieceHashes(dict):
    """Word, with any space behind it -> hash that places the cuts, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.rstrip(_SPACE).encode("utf-8", "surrogatepass"))
        return h


_hashes = PieceHashes()
_FIRST = np.uint64(0x9E3779B97F4A7C15)          # marks the first word of a sentence or piece


@lru_cache(maxsize=2)
def _layout(text: str) -> tuple[np.ndarray, list[int]]:
    """Where the words of a text start, and their hashes."""
    words = _words(text)
    lead = len(text) - len(text.lstrip(_SPACE))
    return np.fromiter(accumulate(map(len, words[:-1]), initial=lead), dtype=np.int64, count=len(words)) if words else \
        np.empty(0, dtype=np.int64), list(map(_hashes.__getitem__, words))


def _starts(text: str, long: int) -> np.ndarray:
    """Where the sentences and the clauses of those of more than ``long`` words start, and the text's length at the end."""
    starts = [0] + [m.end() for m in _breaks(text)]
    if starts[-1] != len(text) or len(starts) == 1:
        starts.append(len(text))
    s = np.array(starts, dtype=np.int64)
    wide = np.diff(np.searchsorted(_layout(text)[0], s)) > long
    if not wide.any():
        return s
    cuts = np.array([m.end() for m in _clauses(text)], dtype=np.int64)
    of = np.searchsorted(s, cuts, "right") - 1
    return np.union1d(s, cuts[(cuts < len(text)) & (cuts > s[of]) & wide[np.minimum(of, len(wide) - 1)]]) if text else s


def clause_starts(text: str) -> list[int]:
    """Starts of sentences, and of clauses in sentences of more than ``LONG_SENTENCE`` words."""
    return _starts(text, LONG_SENTENCE).tolist()


def sentence_starts(text: str) -> list[int]:
    """Where the sentences start, and the text's length at the end; a sentence owns the space behind it.

    A sentence of more than ``PIECE`` words is cut into its clauses, and a clause of
    more into pieces, so that a passage that shares only part of it is found.  Cuts
    stand before the word with the smallest hash of each ``PIECE`` in a row (the last
    of equal ones): a piece has ``PIECE`` words at most, and two texts cut alike
    between the first and the last such word of what they share.
    """
    s = _starts(text, PIECE)
    places, hashes = _layout(text)
    at_word = np.searchsorted(places, s)
    pieces = []
    for k in np.flatnonzero(np.diff(at_word) > PIECE).tolist():
        low = int(at_word[k])
        h, at = hashes[low:int(at_word[k + 1])], -1
        for end in range(PIECE - 1, len(h)):
            if at <= end - PIECE:
                at = min(range(end, end - PIECE, -1), key=h.__getitem__)
            elif h[end] <= h[at]:
                at = end
            else:
                continue
            if at:
                pieces.append(int(places[low + at]))
    return sorted(s.tolist() + pieces) if pieces else s.tolist()


def runs_of(text: str | None, min_sentences: int, min_words: int, long_words: int,
            cut=sentence_starts) -> list[tuple[bytes, int, int]]:
    """(hash, first sentence, sentences) of each run, by first sentence; equal hashes mean equal words in equal sentences."""
    digests, first, size = _runs(text, min_sentences, min_words, long_words, cut)
    return list(zip(digests, first.tolist(), size.tolist()))


_NONE = np.empty(0, dtype=np.int64)


def _runs(text: str | None, min_sentences: int, min_words: int, long_words: int, cut) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    if not text:
        return [], _NONE, _NONE
    starts = cut(text)
    places, hashes = _layout(text)
    n, w = len(starts) - 1, np.searchsorted(places, starts)
    at = np.arange(n)
    # shortest run from each sentence on, and up to each
    end = np.minimum(np.searchsorted(w, w[:-1] + long_words), np.maximum(np.searchsorted(w, w[:-1] + min_words), at + min_sentences))
    first = np.maximum(np.searchsorted(w, w[1:] - long_words, "right") - 1,
                       np.minimum(np.searchsorted(w, w[1:] - min_words, "right") - 1, at + 1 - min_sentences))
    back = np.flatnonzero(first >= 0)
    back = back[end[first[back]] != back + 1]                       # not found from its first sentence already
    runs = np.sort(np.concatenate([(at * (n + 1) + end)[end <= n], first[back] * (n + 1) + back + 1]))
    if not len(runs):
        return [], _NONE, _NONE
    marked = np.array(hashes, dtype=np.uint64)
    marked[np.unique(w[:-1][w[:-1] < len(marked)])] ^= _FIRST
    whole, low, high = marked.tobytes(), runs // (n + 1), runs % (n + 1)
    digests = [xxhash.xxh3_128_digest(whole[8 * a:8 * b]) for a, b in zip(w[low].tolist(), w[high].tolist())]
    blank = np.append(0, np.cumsum(np.diff(w) == 0))                # sentences without words count, too
    for k in np.flatnonzero(blank[high] > blank[low]).tolist():
        digests[k] = xxhash.xxh3_128_digest(digests[k] + np.diff(w[low[k]:high[k] + 1]).astype("<i8").tobytes())
    return digests, low, high - low


def own_repeats(text: str, *least: int) -> list[int]:
    """First sentence and sentences, in turns, of the runs of whole clauses that stand earlier in the text too."""
    seen: set[bytes] = set()
    out: list[int] = []
    wide, number = clause_starts(text), {start: i for i, start in enumerate(sentence_starts(text))}
    for h, i, size in runs_of(text, *least, cut=clause_starts):
        if h in seen:
            first = number[wide[i]]
            out += (first, number[wide[i + size]] - first)
        seen.add(h)
    return out


def _runs_udf(min_sentences: int, min_words: int, long_words: int):
    least = (min_sentences, min_words, long_words)

    def runs(texts: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {"hi": [], "lo": [], "first": [], "size": [], "own": []}
        for text in texts:
            hashes, first, size = _runs(text, *least, sentence_starts)
            keys = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)       # 96 bits of the hash
            out["hi"].append(np.ascontiguousarray(keys[:, 0]))
            out["lo"].append(keys[:, 1].astype(np.int32))
            out["first"].append(first.astype(np.int32))
            out["size"].append(size.astype(np.int32))
            # clauses repeat only where their pieces do
            out["own"].append(own_repeats(text, *least) if len(set(hashes)) < len(hashes) else [])
        return pd.DataFrame({k: pd.Series(v, dtype="object") for k, v in out.items()})
    return F.pandas_udf(runs, RUNS)


def remove_spans(text: str, spans) -> tuple[str, int, int]:
    """The text without the sentences of ``spans`` (first, size, in turns), how many those are, and their words."""
    starts = sentence_starts(text)
    gone = np.zeros(len(starts), dtype=np.int64)
    spans = np.asarray(spans, dtype=np.int64)
    first, end = spans[0::2], spans[0::2] + spans[1::2]
    inside = (0 <= first) & (first < end) & (end < len(starts))          # spans outside the text are no spans of it
    np.add.at(gone, first[inside], 1)
    np.add.at(gone, end[inside], -1)
    gone = np.cumsum(gone)[:-1] > 0
    keep = "".join(text[a:b] for a, b, g in zip(starts, starts[1:], gone) if not g)
    words = sum(len(text[a:b].encode("utf-8", "surrogatepass").split()) for a, b, g in zip(starts, starts[1:], gone) if g)
    return keep.rstrip(" \t\x0b\x0c\r\n") if gone[-1] else keep, int(gone.sum()), words


def _remove(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([remove_spans(t, s) if t is not None and s is not None else (None, 0, 0)
                         for t, s in zip(texts, spans)], columns=["text", "n_removed", "words_removed"])


def repeated_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                   long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, key, spans): per document, the runs to remove as first sentence and size in turns; key: its text's.

    Null doc_ids come behind all others, one document for each text, in the order of
    ``_z``, half of the text's key.  The first pass over the runs only counts 64 bits of
    their hashes; the second exchange holds a run's hash (96 bits), the number of its
    row and its place; ids come to the runs that are left, those that occur again.
    """
    prepare(docs.sparkSession)
    key = text_key(F.col("text"))
    half = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", key.alias("key"), F.when(F.col("doc_id").isNull(), half).alias("_z"),
                       F.monotonically_increasing_id().alias("_r"),
                       _runs_udf(min_sentences, min_words, long_words)(F.col("text")).alias("r"))
    rows = staged(rows.select("doc_id", "key", "_z", "_r", "r.*"), "runs")
    places = rows.select("_r", F.explode(F.arrays_zip("hi", "lo", "first", "size")).alias("p")).select(
        F.col("p.hi").alias("hi"), F.col("p.lo").alias("lo"), "_r", F.col("p.first").alias("first"), F.col("p.size").alias("size"))
    # counts are combined before the shuffle, so a passage that all documents share is one row per task
    often = staged(rows.select(F.explode("hi").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h"),
                   "repeated-hashes")
    again = staged(places.join(often, F.col("hi") == F.col("_h"), "left_semi"), "repeated-runs")
    again = again.join(rows.select(F.col("_r").alias("_row"), "doc_id", "_z"), F.col("_r") == F.col("_row")).drop("_row")
    first = again.groupBy("hi", "lo").agg(F.min("doc_id").alias("at"), F.min("_z").alias("_az"), F.count(F.lit(1)).alias("n")).filter(
        "n > 1").select(F.col("hi").alias("_h"), F.col("lo").alias("_l"), "at", "_az")
    later = again.join(first, (F.col("hi") == F.col("_h")) & (F.col("lo") == F.col("_l"))).filter(
        "doc_id > at OR doc_id IS NULL AND (at IS NOT NULL OR _z > _az)")
    spans = later.select("_r", "first", "size").unionByName(
        rows.filter(F.size("own") > 0).select("_r", F.explode(F.transform(
            F.sequence(F.lit(0), F.size("own") - 1, F.lit(2)),
            lambda i: F.struct(F.get("own", i).alias("first"), F.get("own", i + 1).alias("size")))).alias("p")).select(
            "_r", "p.first", "p.size"))
    # a row's list is bounded by its own runs
    spans = spans.groupBy(F.col("_r").alias("_s")).agg(F.flatten(F.collect_set(F.array("first", "size"))).alias("spans"))
    # equal rows have equal lists
    out = staged(rows.select("doc_id", "key", "_r").join(spans, F.col("_r") == F.col("_s")).groupBy("doc_id", "key").agg(
        F.first("spans").alias("spans")), "spans")
    drop_staged(rows)
    return out


def deduplicate_spans(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_removed and words_removed, and the text that is left.

    Null texts stay null and empty ones empty; texts without a run long enough stay
    whole.  Rows that share a doc_id are one document: they do not remove each
    other's passages, but keep their own texts.  Rows with a null doc_id come behind
    all others, one document for each different text, in the order of the texts'
    keys.  An empty table gives an empty result.  Other columns are not read.
    """
    spans = repeated_spans(docs, **options).select(F.col("doc_id").alias("_sd"), F.col("key").alias("_sk"), "spans")
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("_k"))
    out = rows.join(spans, (F.col("_k") == F.col("_sk")) & F.col("doc_id").eqNullSafe(F.col("_sd")), "left")
    # texts that stay whole do not go through Python
    touched = F.when(F.col("spans").isNotNull(), F.col("text"))
    out = out.withColumn("_left", F.pandas_udf(_remove, "text string, n_removed int, words_removed int")(touched, F.col("spans")))
    return out.select("doc_id", F.col("_left.n_removed").alias("n_removed"), F.col("_left.words_removed").alias("words_removed"),
                      F.coalesce("_left.text", "text").alias("text"))

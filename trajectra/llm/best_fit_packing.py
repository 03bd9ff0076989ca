"""Packing of documents into sequences by Martello-Toth reduction and best fit.

Only the length of a piece matters for packing, so the instance is a histogram with
one count per length, whatever the number of documents.  On it, sets of pieces that
provably dominate every other set with the same longest piece are fixed for good
(as many times over as the counts allow), which shrinks the instance; what is left
is packed by best fit in falling order of length.  The plan says which ranks of each
length go where; the pieces are numbered within their length and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajectra.llm.common import number_in_groups, prepare, staged, text_key

CAPACITY = 1024
END = 2                                 # id after each document

Pattern = list[tuple[int, int]]         # (length, times), the longest first


def _at_most(counts: list[int], top: int) -> int:
    """The greatest length up to ``top`` that is left, or 0."""
    while top > 0 and not counts[top]:
        top -= 1
    return max(top, 0)


def _lightest(counts: list[int], n: int, above: int = 0) -> list[int]:
    """The ``n`` smallest lengths left that are greater than ``above`` (fewer, if fewer are left)."""
    out: list[int] = []
    for s in range(above + 1, len(counts)):
        if counts[s]:
            out += [s] * min(counts[s], n - len(out))
            if len(out) == n:
                break
    return out


def _best_pair(counts: list[int], room: int) -> tuple[int, int]:
    """Lengths a >= b of two pieces left, their sum the greatest up to ``room``; of equal sums the one with the greatest a."""
    best = (0, 0)
    a = _at_most(counts, min(room, len(counts) - 1))
    while 2 * a > sum(best) and sum(best) < room:
        b = _at_most(counts, min(a, room - a))
        if b == a and counts[a] < 2:
            b = _at_most(counts, a - 1)
        if b and a + b > sum(best):
            best = (a, b)
        a = _at_most(counts, a - 1)
    return best


def dominating_set(counts: list[int], longest: int, capacity: int) -> list[int] | None:
    """Pieces to put with a piece of length ``longest`` so that no other choice can be better, or None if unknown.

    The set dominates if the partners of every other feasible set can be swapped
    against its own, each own one at least as long as those that it replaces:
    nothing fits; one partner at most fits, or fills the sequence (the longest that
    fits); two at most fit, and one is as long as any two; or two at most fit, the
    longest that fits is in the best pair, and no feasible pair has both its pieces
    longer than the pair's shorter one.
    """
    counts[longest] -= 1
    try:
        room = capacity - longest
        one = _at_most(counts, min(room, len(counts) - 1))
        if not one:
            return []
        light = _lightest(counts, 3)
        fit = sum(sum(light[:k]) <= room for k in range(1, len(light) + 1))
        if fit == 1 or one == room:
            return [one]
        if fit == 2:
            a, b = _best_pair(counts, room)
            if one >= a + b:
                return [one]
            if a == one:
                heavier = _lightest(counts, 2, b)
                if len(heavier) < 2 or sum(heavier) > room:
                    return [a, b]
        return None
    finally:
        counts[longest] += 1


def reduce_instance(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Fixed sets as (how many times, pattern); takes their pieces out of ``counts`` (index: length)."""
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        for s in range(len(counts) - 1, 0, -1):
            while counts[s]:
                partners = dominating_set(counts, s, capacity)
                if partners is None:
                    break
                pattern: dict[int, int] = {}
                for x in [s, *partners]:
                    pattern[x] = pattern.get(x, 0) + 1
                # the reasons stay true while the pieces last: taking pieces away makes no other set better
                times = min(counts[x] // n for x, n in pattern.items())
                for x, n in pattern.items():
                    counts[x] -= times * n
                fixed.append((times, sorted(pattern.items(), reverse=True)))
                changed = True
    return fixed


def best_fit(counts: list[int], capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit in falling order of length for all pieces of ``counts``: (how many sequences, pattern).

    Sequences with the same content are one entry, so the work depends on the number
    of lengths, not of pieces; the result is that of placing piece by piece.
    """
    room: dict[int, list[tuple[int, Pattern]]] = {}
    for s in range(len(counts) - 1, 0, -1):
        n = counts[s]
        while n:
            r = min((r for r in room if r >= s), default=0)
            if r:
                m, pattern = room[r].pop()
                if not room[r]:
                    del room[r]
            else:
                r, m, pattern = capacity, n, []
            t = min(r // s, n)
            use = min(m, n // t)
            room.setdefault(r - t * s, []).append((use, [*pattern, (s, t)]))
            n -= use * t
            if pattern and m > use:
                room.setdefault(r, []).append((m - use, pattern))
    return [x for group in room.values() for x in group]


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, Pattern]]:
    """All sequences for a histogram of lengths: the fixed sets, then best fit for the rest."""
    left = list(counts)
    return reduce_instance(left, capacity) + best_fit(left, capacity)


def lower_bound(counts: list[int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: for each threshold, the long pieces and what the middle ones need beyond their room."""
    best = 0
    for k in range(capacity // 2 + 1):
        big = sum(c for s, c in enumerate(counts) if s > capacity - k)
        half = [(s, c) for s, c in enumerate(counts) if capacity // 2 < s <= capacity - k]
        rest = sum(s * c for s, c in enumerate(counts) if max(k, 1) <= s <= capacity // 2)
        free = sum((capacity - s) * c for s, c in half)
        best = max(best, big + sum(c for _, c in half) + max(0, -(-(rest - free) // capacity)))
    return best


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of each row of ``docs`` (doc_id, text): doc_id, _key, piece, start, length, ids_crc32[, ids].

    A document is the ids of its text and ``end``; one of more than ``capacity`` ids
    is cut so that only its first piece is shorter.
    """
    spark = docs.sparkSession
    prepare(spark)
    narrow = docs.select("doc_id", "text", text_key(F.col("text")).alias("_key"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("_key", T.StringType()), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())]
                          + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["text"].tolist()]
            for lo, hi in _slices(texts):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, ids in enumerate(encode(texts[lo:hi]), lo):
                    ids = np.append(ids, np.int32(end)).astype("<i4")
                    a, k = 0, len(ids) % capacity or capacity
                    n = 0
                    while a < len(ids):
                        part = ids[a:a + k]
                        row.append(i)
                        piece.append(n)
                        start.append(a)
                        length.append(k)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                        a, k, n = a + k, capacity, n + 1
                out = pd.DataFrame({"doc_id": b["doc_id"].iloc[row].array, "_key": b["_key"].iloc[row].array,
                                    "piece": np.array(piece, dtype=np.int32), "start": start, "length": length, "ids_crc32": crc})
                if with_ids:
                    out["ids"] = held
                yield out

    return narrow.mapInPandas(cut, schema)


_ENCODERS: dict = {}


def _encoder(path: str):
    from trajectra.llm.token_ids import TokenIds
    if path not in _ENCODERS:
        _ENCODERS[path] = TokenIds(path)
    return _ENCODERS[path]


def _slices(texts: list[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters in all, or one text."""
    lo, have = 0, 0
    for i, t in enumerate(texts):
        if have and have + len(t) > most:
            yield lo, i
            lo, have = i, 0
        have += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _placed(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` (staged pieces) with sequence_id and offset."""
    spark = rows.sparkSession
    counts = [0] * (capacity + 1)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():      # one row per length: at most ``capacity``
        counts[r["length"]] = r["n"]
    slots, base, ranks = [], 0, [0] * (capacity + 1)
    for times, pattern in plan(counts, capacity):
        offset = 0
        for s, t in pattern:
            slots.append((s, ranks[s], ranks[s] + times * t, base, t, offset))
            ranks[s] += times * t
            offset += s * t
        base += times
    slots = spark.createDataFrame(slots, "_s long, _lo long, _hi long, _base long, _times long, _offset long")
    ranked = number_in_groups(rows, "length", ["doc_id", "piece", "_key", "_row"], sum(counts), "_rank")
    # the slots depend on the number of lengths only (a few thousand rows at most): broadcast
    out = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_s")) & (F.col("_rank") >= F.col("_lo"))
                      & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return out.withColumn("sequence_id", F.col("_base") + F.floor(nth / F.col("_times")).cast("long")).withColumn(
        "offset", F.col("_offset") + nth % F.col("_times") * F.col("length"))


def _staged_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    rows = pieces(docs, tokenizer, capacity, end, with_ids)
    return staged(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Place of each piece of each row of ``docs`` (doc_id, text) in as few sequences as the method finds.

    ``tokenizer``: path of a file of the ``tokenizers`` library that every worker can
    read.  Returns doc_id, piece (from 0), start (the document's ids before it),
    length, ids_crc32 (unsigned, of the little-endian 32-bit ids), sequence_id (from 0)
    and offset (place in the sequence; gapless from 0).

    Null texts count as empty ones; these are the end id alone.  Repeated rows are
    packed each; null doc_ids are kept.  Ties between pieces of one length go by doc_id, piece
    and text inside hashed bins.  An empty table gives an empty result.  Other columns
    are not read.
    """
    return _placed(_staged_pieces(docs, tokenizer, capacity, end, False), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the doc_ids, starts and lengths of their pieces in order.

    Rows as for ``pack``; a group is one sequence, so never more than ``capacity`` ids.
    """
    placed = _placed(_staged_pieces(docs, tokenizer, capacity, end, True), capacity)
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return placed.groupBy("sequence_id").agg(held.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"),
        F.col("p.length").alias("lengths"))

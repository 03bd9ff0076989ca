"""Spelling variants: words one letter apart, by a dictionary of trie-node pairs.

The nodes of the trie of all words, and of the trie of the reversed words, are
numbered.  A word is then a list of pairs (node of a prefix, node of the suffix that
follows): with nothing between them, or with one position skipped.  Two words that
differ by one replaced letter have an equal pair around that position; a word with
one letter less has, with nothing between, the pair that the longer one has around
the letter.  So equal pairs of integers give exactly the words one letter apart.

Nodes are numbered without a dictionary to look them up in: the words are range-sorted,
a word's new nodes are those beyond its common prefix with the word before, and the
nodes that ranges share are named after the first border that they cross.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.llm.common import prepare, staged

SHORTEST = 5
LEAST = 3
DAMAGE = 97             # a run whose hash this divides loses one letter
PER_RANGE = 50_000      # words that one task numbers
HELD = 100_000          # different words that a task counts before it passes them on


def _counter(shortest: int, damage: int | None):
    find = re.compile("[a-zÀ-ÿ]{%d,}" % shortest).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())],
                                               names=["word", "n"])
            total.clear()
            return batch

        for b in batches:
            for i in range(b.num_rows):
                doc_id, text = b.column("id")[i].as_py(), b.column("text")[i].as_py()
                # bytes.lower() touches A-Z only
                runs = find(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
                if not damage:
                    total.update(runs)
                else:
                    start = zlib.crc32(f"{doc_id}:".encode())
                    for run, n in Counter(runs).items():
                        h = zlib.crc32(run.encode(), start)
                        if h % damage == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < shortest:
                                continue
                        total[run] += n
                if len(total) > HELD:
                    yield out()
        if total:
            yield out()
    return run


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) with at least ``shortest`` letters and ``least`` occurrences.

    Words are runs of A-Z, a-z and U+00C0-U+00FF, A-Z lower-cased.  With ``damage``, a
    run whose crc32 of "doc_id:run" it divides loses one letter first (a null doc_id is
    an empty string).
    """
    prepare(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(_counter(shortest, damage), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- tries -----------------------------------------------------------------

def _common(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def border_names(ranges: list[dict]) -> list[list[int]]:
    """Numbers of the nodes that each range shares with the next one, by depth.

    ``ranges``: first and last word of each, in order.  A node keeps the number that it
    gets at the first border it crosses; these are negative, others are not.
    """
    names, used = [], 0
    for k, r in enumerate(ranges[:-1]):
        depth = _common(r["last"], ranges[k + 1]["first"])
        known = min(depth, _common(r["first"], r["last"]), len(names[-1]) - 1) + 1 if names else 0
        own = names[-1][:known] if names else []
        fresh = depth + 1 - known
        names.append(own + [-(used + i + 1) for i in range(fresh)])
        used += fresh
    return names


def _numberer(borders: dict):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start, first, below, last, above = borders[int(pdf["part"].iloc[0])]
        pdf = pdf.sort_values("key", kind="stable")
        before, path, ids, paths = "", [], [], []
        for nth, word in enumerate(pdf["key"]):
            shared = _common(before, word) if nth else -1
            nodes = path[:shared + 1] + list(range(start + shared + 1, start + len(word) + 1))
            if not nth and below:
                k = len(below)
                nodes[:k] = below
            if above:
                k = min(_common(word, last), len(above) - 1)
                nodes[:k + 1] = above[:k + 1]
            ids.append(start)
            paths.append(np.array(nodes, dtype=np.int64))
            before, path = word, nodes
            start += len(word) + 1
        return pd.DataFrame({"id": ids, "word": pdf["word"].to_numpy(), "n": pdf["n"].to_numpy(), "path": paths})
    return run


def trie_paths(words: DataFrame, backwards: bool = False, per_range: int = PER_RANGE) -> DataFrame:
    """``words`` (word, n; staged) with id and path: the numbers of the trie nodes from the root to the word.

    ``backwards``: of the trie of the reversed words.  Ids rise with the order of the keys.
    """
    parts = max(1, -(-words.count() // per_range))
    key = F.reverse("word") if backwards else F.col("word")
    ranged = staged(words.withColumn("key", key).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    # two words and a sum for each range of ``per_range`` words
    ranges = ranged.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"),
                                        F.sum(F.length("key") + 1).alias("size")).orderBy("first").collect()
    names, start, borders = border_names([r.asDict() for r in ranges]), 0, {}
    for k, r in enumerate(ranges):
        borders[r["part"]] = (start, r["first"], names[k - 1] if k else [], r["last"], names[k] if k < len(names) else [])
        start += r["size"]
    return ranged.groupBy("part").applyInPandas(_numberer(borders), "id long, word string, n long, path array<long>")


def near_words(words: DataFrame, per_range: int = PER_RANGE) -> DataFrame:
    """(id, word, n, n_near, best) for ``words`` (word, n; staged): how many words are one letter away, and the most frequent.

    best: struct (n negated, id), null if there is none; ids rise in code-point order.
    """
    forward = trie_paths(words, False, per_range).withColumnRenamed("path", "ahead")
    back = trie_paths(words, True, per_range).select(F.col("word").alias("_w"), F.col("path").alias("behind"))
    known = staged(forward.join(back, F.col("word") == F.col("_w")).drop("_w"), "paths")
    size = F.length("word")
    # kind 0: nothing between prefix and suffix; 1, 2: a letter skipped (1: the letter before is the same, so
    # that taking this one out gives nothing new)
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        F.get("ahead", i).alias("p"), F.get("behind", size - i).alias("s"), F.lit(0).alias("kind")))
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("ahead", i).alias("p"), F.get("behind", size - 1 - i).alias("s"),
        F.when((i > 0) & (F.col("word").substr(i + 1, F.lit(1)) == F.col("word").substr(i, F.lit(1))), 1).otherwise(2).alias("kind")))
    pairs = known.select("id", "n", F.inline(F.concat(whole, skipped)))
    # words of one pair differ in one letter only: at most one a letter of the alphabet, and the one without it
    groups = pairs.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "id", "kind"))).alias("g")).filter(
        F.size("g") > 1)
    parts = groups.select("g", F.filter("g", lambda x: x["kind"] > 0).alias("skips"), F.filter("g", lambda x: x["kind"] == 2).alias("outs"),
                          F.filter("g", lambda x: x["kind"] == 0).alias("short"))
    one = parts.select(F.explode("g").alias("x"), "skips", "outs", "short")
    top = lambda a, i: F.when(F.get(a, F.lit(i)).isNotNull(), F.struct(F.get(a, F.lit(i))["m"].alias("m"), F.get(a, F.lit(i))["id"].alias("id")))
    beside = F.when(F.get("skips", F.lit(0))["id"] == F.col("x.id"), top("skips", 1)).otherwise(top("skips", 0))
    found = one.select(
        F.col("x.id").alias("_id"),
        F.when(F.col("x.kind") == 0, F.size("outs")).when(F.col("x.kind") == 1, F.size("skips") - 1)
        .otherwise(F.size("skips") - 1 + F.size("short")).alias("c"),
        F.when(F.col("x.kind") == 0, top("outs", 0)).when(F.col("x.kind") == 1, beside)
        .otherwise(F.least(beside, top("short", 0))).alias("b")).filter("c > 0")
    near = found.groupBy("_id").agg(F.sum("c").alias("n_near"), F.min("b").alias("best"))
    return known.select("id", "word", "n").join(near, F.col("id") == F.col("_id"), "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")


def _roots(steps: DataFrame) -> DataFrame:
    """``steps`` (id, to) followed to their ends: (id, to).  Counts at least double with a step, so rounds are few."""
    while True:
        onward = steps.select(F.col("id").alias("_i"), F.col("to").alias("_t"))
        steps = staged(steps.join(onward, F.col("to") == F.col("_i"), "left").select(
            "id", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("moved")), "roots")
        moved = not steps.filter("moved").isEmpty()
        steps = steps.select("id", "to")
        if not moved:
            return steps


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, damage: int | None = DAMAGE,
             per_range: int = PER_RANGE) -> DataFrame:
    """Words of ``docs`` (doc_id, text) with their near words: word, form, root, n, n_near, form_n.

    Words as in ``word_counts``.  Two words are near if one inserted, deleted or replaced
    letter makes them equal.  form: the near word with the greatest n (of equal ones the
    smallest in code-point order) if that is at least twice the word's n, else null; root: the
    last word on the way along forms, the word itself if it has none.

    Null texts have no words; a null doc_id counts as an empty string.  Repeated rows
    count each.  Without words the result is empty.  Other columns are not read.
    """
    words = staged(word_counts(docs, shortest, least, damage), "words")
    if words.isEmpty():
        return words.select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n",
                            F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    near = near_words(words, per_range)
    has = -F.col("best.m") >= 2 * F.col("n")
    near = staged(near.select("id", "word", "n", "n_near", F.when(has, F.col("best.id")).alias("to"),
                              F.when(has, -F.col("best.m")).alias("form_n")), "near")
    roots = _roots(near.filter("to IS NOT NULL").select("id", "to")).select(F.col("id").alias("_r"), F.col("to").alias("top"))
    named = near.select(F.col("id").alias("_i"), F.col("word").alias("_w"))
    out = near.join(roots, F.col("id") == F.col("_r"), "left")
    out = out.join(named.select(F.col("_i").alias("_f"), F.col("_w").alias("form")), F.col("to") == F.col("_f"), "left")
    out = out.join(named.select(F.col("_i").alias("_t"), F.col("_w").alias("_top")), F.col("top") == F.col("_t"), "left")
    return out.select("word", "form", F.coalesce("_top", "word").alias("root"), "n", "n_near", "form_n")

"""Near-duplicate detection with DartMinHash signatures.

A text is a set of five-word shingles, each with a weight.  Every (shingle,
weight strip, rank level) cell gets a Poisson number of darts from its hash; a
dart falls at a weight, a rank and a coordinate.  Darts below the shingle's weight
count, and the earliest dart of each coordinate is the signature.  Two texts agree
in a coordinate with the probability of their weighted Jaccard similarity.  Rank
levels are opened only until every coordinate has a dart, so the work is about the
number of shingles plus k log k, not their product.

Signatures are cut into bands.  The texts of a band bucket are linked to its
smallest member and to their neighbour in order of size, never all with all; each
link is then checked exactly on the full shingle sets, and connected components of
the links are the classes.  Buckets that still hold texts of several components are
searched for the links between these by a prefix join on the shingles, so none depends
on which text came first.  Shingles are compared by 32-bit hashes: two of a text's
few hundred collide with another text's once in some millions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trajectra.llm.common import attach, prepare, staged, text_key

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 64
BAND = 4                     # coordinates in a band: a pair at 0.8 is missed by all 16 bands once in 4,600
FIRST_RANK = 2.0 ** -6
CHUNK = 200_000              # shingles whose darts are thrown at once
DRAWS = 3                    # rounds in which texts meet one drawn text of each bucket they share with other components
HOLDERS = 500                # holders of a shared shingle outside its main component that one key takes

_words = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit integers (public-domain splitmix constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0 ** -53


def _salt(*parts: int) -> np.uint64:
    return _U(xxhash.xxh64_intdigest(repr(parts)))


_cdf: dict[float, np.ndarray] = {}


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts with one mean from uniforms, by the inverse distribution."""
    if mean not in _cdf:
        top = int(mean + 12 * math.sqrt(mean) + 20)
        _cdf[mean] = np.cumsum([math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(top)])
    return np.searchsorted(_cdf[mean], u, side="right")


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the ``size``-word shingles of a lower-cased text, in order.

    Words are runs of letters, digits and non-ASCII characters.  A text with
    fewer words, but not none, is one shingle.
    """
    words = _words(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size_here = min(size, len(h))
    n = len(h) - size_here + 1
    out = np.full(n, size_here, dtype=np.uint64)
    for j in range(size_here):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[j:j + n])
    return out


def dart_signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int,
                    k: int = COORDINATES, seed: int = 1) -> np.ndarray:
    """DartMinHash signatures (n x k, uint64) of ``n`` weighted sets.

    ``elements``, ``weights`` (> 0; meant for weights of about 1 and more) and
    ``owner`` (0..n-1, every owner present) are parallel.  Equal weighted sets get
    equal signatures.
    """
    strips = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1.0)))).astype(np.int64) + 1
    at = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(at)) - np.repeat(np.cumsum(strips) - strips, strips)
    cell_el, cell_w, cell_o = elements[at], weights[at], owner[at]
    sig = np.zeros(n * k, dtype=np.uint64)
    full = np.zeros(n * k, dtype=bool)
    level = 0
    while len(cell_el):
        low, high = (0.0, FIRST_RANK) if level == 0 else (FIRST_RANK * 2 ** (level - 1), FIRST_RANK * 2 ** level)
        hs, ws, os_, ranks = [], [], [], []
        for s in np.unique(strip):
            mine = strip == s
            w0, w1 = (0.0, 1.0) if s == 0 else (2.0 ** (s - 1), 2.0 ** s)
            cell = mix64(cell_el[mine] ^ _salt(seed, int(s), level))
            count = _poisson(_unit(cell), (w1 - w0) * (high - low))
            hit = np.flatnonzero(count)
            count = count[hit]
            cell = np.repeat(cell[hit], count)
            nth = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix64(cell + (nth.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
            weight = w0 + (w1 - w0) * _unit(mix64(dart ^ _salt(seed, 7)))
            below = weight < np.repeat(cell_w[mine][hit], count)
            dart = dart[below]
            hs.append(dart)
            os_.append(np.repeat(cell_o[mine][hit], count)[below])
            ranks.append(_unit(mix64(dart ^ _salt(seed, 8))))
        dart, own, rank = np.concatenate(hs), np.concatenate(os_), np.concatenate(ranks)
        slot = own * k + (mix64(dart ^ _salt(seed, 9)) % _U(k)).astype(np.int64)
        free = ~full[slot]
        dart, rank, slot = dart[free], rank[free], slot[free]
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        sig[slot[first]] = dart[first]
        full[slot[first]] = True
        open_ = ~full.reshape(n, k).all(axis=1)
        go = open_[cell_o]
        cell_el, cell_w, cell_o, strip = cell_el[go], cell_w[go], cell_o[go], strip[go]
        level += 1
    return sig.reshape(n, k)


def bands_of(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    n, k = sig.shape
    out = np.empty((n, k // band), dtype=np.uint64)
    for b in range(k // band):
        h = np.full(n, _salt(2, b), dtype=np.uint64)
        for j in range(band):
            h = mix64(h * _U(0x9E3779B97F4A7C15) + sig[:, b * band + j])
        out[:, b] = h
    return out


def _sketch_udf(counted: bool, k: int, band: int, size: int):
    @F.pandas_udf("bands array<long>, shingles array<int>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for texts in batches:
            bands: list = [np.empty(0, dtype=np.int64)] * len(texts)
            sets: list = [None] * len(texts)
            todo, have = [], 0

            def flush():
                nonlocal todo, have
                if todo:
                    lengths = [len(e) for _, e, _ in todo]
                    sig = dart_signatures(np.concatenate([e for _, e, _ in todo]), np.concatenate([w for _, _, w in todo]),
                                          np.repeat(np.arange(len(todo)), lengths), len(todo), k)
                    for (i, _, _), row in zip(todo, bands_of(sig, band).view(np.int64)):
                        bands[i] = row
                    todo, have = [], 0

            for i, text in enumerate(texts):
                el, n = np.unique(shingles(text, hashes, size), return_counts=True)
                if counted:      # the j-th occurrence is an element of its own, so set overlap is multiset overlap
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    kept = mix64(np.repeat(el, n) + nth.astype(np.uint64))
                else:
                    kept = el
                sets[i] = np.unique(kept.astype(np.uint32)).view(np.int32)
                if len(el):
                    todo.append((i, el, n.astype(np.float64) if counted else np.ones(len(el))))
                    have += len(el)
                    if have >= CHUNK:
                        flush()
            flush()
            yield pd.DataFrame({"bands": bands, "shingles": sets})
    return sketch


def sketch(docs: DataFrame, counted: bool = False, k: int = COORDINATES, band: int = BAND, size: int = SHINGLE) -> DataFrame:
    """For every row of ``docs``: doc_id, node (key of the text), bands, shingles (their 32-bit hashes), n of them."""
    prepare(docs.sparkSession)
    out = docs.select("doc_id", text_key(F.col("text")).alias("node"),
                      _sketch_udf(counted, k, band, size)(F.col("text")).alias("s"))
    return out.select("doc_id", "node", "s.bands", "s.shingles", F.size("s.shingles").alias("n"))


def bucket_rows(texts: DataFrame) -> DataFrame:
    """(band, node, n, first) of the buckets that hold several texts; first is the bucket's smallest (node, n)."""
    rows = texts.select(F.explode("bands").alias("band"), "node", "n")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("node", "n")).alias("first")).filter("m > 1")
    return rows.join(shared.select(F.col("band").alias("_b"), "first"), F.col("band") == F.col("_b")).drop("_b")


def _sizes_fit(x, y, similarity: float):
    return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9


def candidate_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts in one bucket: each with the bucket's smallest and with its neighbour by size.

    Two links a member at most, so a bucket of any size gives links in proportion
    to its members.  Sizes further apart than ``similarity`` allows make no link.
    """
    star = rows.filter(F.col("node") != F.col("first.node")).filter(_sizes_fit(F.col("n"), F.col("first.n"), similarity)).select(
        F.col("first.node").alias("a"), F.col("node").alias("b"))
    order = W.partitionBy("band", "_size").orderBy("n", "node")
    parts = rows.withColumn("_size", F.floor(F.log2(F.col("n").cast("double"))))
    chain = parts.select("node", "n", F.lag("node").over(order).alias("p"), F.lag("n").over(order).alias("pn")).filter(
        "p IS NOT NULL").filter(_sizes_fit(F.col("n"), F.col("pn"), similarity)).select(
        F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b"))
    return star.unionByName(chain).distinct()


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, n, label) of the buckets whose texts are of several components."""
    known = labels.select(F.col("node").alias("_n"), "label")
    rows = rows.select("band", "node", "n").join(known, F.col("node") == F.col("_n"), "left").select(
        "band", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select(
        F.col("band").alias("_b"))
    return rows.join(mixed, F.col("band") == F.col("_b"), "left_semi")


def crossing_links(rows: DataFrame, labels: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket: each text with one drawn by hash for the bucket and ``turn``."""
    rows = staged(_mixed(rows, labels), "mixed")
    drawn = rows.groupBy("band").agg(F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", "band", F.lit(turn))).alias("d"))
    met = rows.join(drawn.select(F.col("band").alias("_b"), "d"), F.col("band") == F.col("_b"))
    met = met.filter((F.col("label") != F.col("d.label")) & _sizes_fit(F.col("n"), F.col("d.n"), similarity))
    return met.select(F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")).distinct()


def remaining_links(rows: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts in mixed buckets, of different components, that may reach ``similarity``: a prefix join.

    A text's shingles are put in order of rarity among the texts of these buckets.  Two
    sets that reach the similarity share at least t / (1 + t) of their sizes' sum, so
    their first shared shingle stands early in both: nothing but a text's first
    n - ceil(t n) + 1 shingles is joined, and a pair only where what is left behind the
    shared shingle still suffices for both.  Of the holders of a shingle, those outside
    its most frequent component meet all holders; shingles of one component are done.
    Many holders are dealt over several keys.  No pair that reaches the similarity is lost.
    """
    mixed = staged(_mixed(rows, labels).select("node", "label").distinct(), "mixed")
    texts = staged(mixed.join(sets, "node").select("node", "label", "shingles", F.size("shingles").alias("n")), "mixed-sets")
    tokens = texts.select("node", F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    total = texts.agg(F.sum("n")).first()[0] or 0
    ranked = attach(tokens, often, "s", "f", total, F.hash("node"))
    ranked = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s"))).alias("r"))
    first = F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1
    prefix = ranked.join(texts.select(F.col("node").alias("_n"), "label", "n"), F.col("node") == F.col("_n")).select(
        "node", "label", "n", F.posexplode(F.slice("r", F.lit(1), first.cast("int"))).alias("i", "x"))
    prefix = staged(prefix.filter("x.f > 1").select("node", "label", "n", "i", F.col("x.s").alias("s")), "prefixes")
    held = prefix.groupBy("s", "label").agg(F.count(F.lit(1)).alias("m"))
    held = held.groupBy("s").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("c"), F.max(F.struct("m", "label")).alias("main")).filter("c > 1")
    held = staged(held.select(F.col("s").alias("_s"), F.col("main.label").alias("main"),
                              F.ceil((F.col("m") - F.col("main.m")) / HOLDERS).cast("int").alias("h")), "holders")
    both = prefix.join(held, F.col("s") == F.col("_s"))
    one = both.filter("label != main").withColumn("k", F.pmod(F.xxhash64("node"), F.col("h")).cast("int"))
    two = both.select(F.col("s").alias("_s2"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("_k"),
                      *[F.col(x).alias(f"_{x}") for x in ("node", "label", "n", "i")])
    need = F.ceil(similarity / (1 + similarity) * (F.col("n") + F.col("_n")) - 1e-9)
    near = one.join(two, (F.col("s") == F.col("_s2")) & (F.col("k") == F.col("_k")) & (F.col("label") != F.col("_label"))
                    & (F.col("i") + need <= F.col("n")) & (F.col("_i") + need <= F.col("_n"))
                    & _sizes_fit(F.col("n"), F.col("_n"), similarity))
    return near.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links whose texts' sets of shingle hashes (32 bits each) overlap by ``similarity`` or more."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = links.join(one, "a").join(two, "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.filter(inter >= similarity * (F.size("sa") + F.size("sb") - inter) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (a, b): (node, label), the label its smallest node.

    Each round hooks every root to the smallest root that any member is linked to,
    follows the hooks to their end, and puts roots in the place of the links' nodes.
    A root without a smaller neighbour either gets one hooked to it, or sees a smaller
    one in the next round, so two rounds at least halve the roots that still have links,
    whatever the order of the nodes; a chain of hooks halves with each step.  Rounds end
    when no link is left.  Links and labels stay distributed; every round is written to
    the shared folder.
    """
    left = staged(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = None
    while True:
        hooks = _followed(staged(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select(
            "node", F.least("node", "_m").alias("label")), "hooks"))
        root = hooks.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        if labels is None:
            labels = hooks
        else:
            labels = staged(labels.join(root, F.col("label") == F.col("_n"), "left").select(
                "node", F.coalesce("_l", "label").alias("label")), "labels")
        for end in ("a", "b"):
            left = left.join(root, F.col(end) == F.col("_n")).withColumn(end, F.col("_l")).drop("_n", "_l")
        left = staged(left.filter("a != b").distinct(), "links")
        if left.isEmpty():
            return labels


def _followed(hooks: DataFrame) -> DataFrame:
    """``hooks`` (node, label) with each label followed to the node that is its own label."""
    while True:
        jump = hooks.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        hooks = staged(hooks.join(jump, F.col("label") == F.col("_n")).select(
            "node", F.col("_l").alias("label"), (F.col("_l") != F.col("label")).alias("moved")), "hooks")
        moved = not hooks.filter("moved").isEmpty()
        hooks = hooks.select("node", "label")
        if not moved:
            return hooks


def _classes(docs: DataFrame, similarity: float, options: dict) -> tuple[DataFrame, DataFrame]:
    rows = staged(sketch(docs, **options), "sketch")
    texts = staged(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"),
                                            F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "texts")
    buckets = staged(bucket_rows(texts), "buckets")
    # texts that share a bucket; equal copies are combined before the shuffle, one row per task
    wanted = buckets.select("node").distinct()
    sets = staged(rows.groupBy("node").agg(F.first("shingles").alias("shingles")).join(wanted, "node", "left_semi"), "sets")
    links = staged(verified(candidate_links(buckets, similarity), sets, similarity), "verified")
    labels = components(links)
    # most texts that missed their bucket's first have many other partners: a few drawn ones find them, in links
    # proportional to the texts; what is then left is searched in full
    for search in [*(partial(crossing_links, turn=t) for t in range(DRAWS)), partial(remaining_links, sets=sets)]:
        more = staged(verified(search(buckets, labels, similarity=similarity), sets, similarity), "verified")
        if not more.isEmpty():
            links = staged(links.unionByName(more).distinct(), "verified")
            labels = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("n_checked_links"))
    member = texts.select("node", "low", "copies").join(labels.withColumnRenamed("node", "_c"),
                                                        F.col("node") == F.col("_c"), "left")
    member = member.join(degree, F.col("node") == F.col("_n"), "left").select(
        "node", "low", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("n_checked_links", F.lit(0)).alias("n_checked_links"))
    member = staged(member, "members")
    total = member.groupBy("label").agg(F.min(F.struct(F.col("low").isNull().alias("z"), "low", "node")).alias("_f"),
                                        F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n_texts")).select(
        F.col("label").alias("_l"), F.col("_f.low").alias("class_id"), F.col("_f.node").alias("kept_node"), "class_size", "n_texts")
    facts = member.join(total, F.col("label") == F.col("_l")).select(
        "node", "copies", "n_checked_links", "class_id", "class_size", "n_texts", "kept_node")
    return rows.select("doc_id", "node"), staged(facts, "classes")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with its class of near duplicates.

    class_id: the smallest doc_id of the class; class_size: its rows; n_texts: its
    different texts; n_checked_links: those links of this text that the search has
    verified (similarity at least ``similarity`` over the 32-bit hashes of distinct five-word
    shingles, or over counted ones with ``counted=True``), no count of all its near
    copies: pairs inside a class already joined are not looked at, so the number
    depends on the order of the text keys and on ``DRAWS``; copies: rows with this
    very text; is_kept: the row's doc_id and text are those that stay.

    Equal texts are one class.  Null texts count as empty ones; these have no
    shingles and make one class.  A text of fewer than five words is one shingle.
    Repeated rows share their class, and is_kept.  Null doc_ids come last in the
    choice of class_id.  An empty table gives an empty result.  Other columns are
    not read.
    """
    rows, facts = _classes(docs, similarity, options)
    out = attach(rows, facts, "node", "copies", rows.count(), F.xxhash64("doc_id", F.monotonically_increasing_id()))
    return out.select("doc_id", "class_id", "class_size", "n_texts", "copies", "n_checked_links",
                      (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("kept_node"))).alias("is_kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """One row of ``docs`` of each class, with its columns: the one with the smallest doc_id.

    Null texts count as empty ones, which are one class; of repeated rows one stays; a row
    without a doc_id stays only if its class has no other.  An empty table gives an
    empty result.  Columns of any name are kept.
    """
    narrow, facts = _classes(docs, similarity, options)
    kept = facts.filter("node = kept_node").select("node", "copies", "class_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       text_key(F.col("text")).alias("node"), F.col("doc_id").alias("_id"))
    out = attach(rows, kept, "node", "copies", narrow.count(), F.xxhash64("_id", F.monotonically_increasing_id()))
    out = out.filter(F.col("copies").isNotNull() & F.col("_id").eqNullSafe(F.col("class_id")))
    if not narrow.groupBy("node", "doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["node", "_id"])        # repeated rows: one stays
    return out.select("_row.*")

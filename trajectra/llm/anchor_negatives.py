"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

Anchors are cut into chunks of near ones, each with its minimum spanning tree.  All
rows are scored exactly against a chunk's root; against a child anchor, a row's score
differs from its score (or bounds) at the parent by at most the edge's length times
the row's norm.  Only rows whose bounds meet what the anchor still looks for are
scored again: the best rows of its label so far, then the windows of its positives
and the best in each so far.  All numbers are integers, so nothing is lost to
rounding.

Anchors meet the rows in blocks: the pair (rows' share, anchors' share) is the key
of a cogroup, each share bounded in bytes.  What a block finds is at most a few rows
an anchor, merged by rank afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trajectra.llm.common import prepare, staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)              # per cent of the positive's score, both ends included
CHUNK = 1024                   # anchors of one tree
SHARE_BYTES = 16_000_000       # vectors of one side of a block
SLICE = 2048                   # rows scored at once

_FOUND = "anchor_id long, slot int, vec_id long, score long"


# ---- vectors ---------------------------------------------------------------

def _integers(scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["vector"]:
                x = np.array([np.nan if e is None else e for e in v] if v.dtype == object else v, dtype=np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    y = np.floor(scale * x)
                    ok = bool(np.isfinite(x).all()) and float(y @ y) < 2.0 ** 62
                out.append((y.astype("<i4").tobytes(), float(np.sqrt(y @ y))) if ok else (None, None))
            df = pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "vec": [o[0] for o in out], "norm": [o[1] for o in out]})
            yield df[df["vec"].notna()]
    return run


def integer_rows(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vec, norm) of the rows that take part, staged; vec: 32-bit integers floor(scale * x)."""
    prepare(rows.sparkSession)
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").alias("vector")).dropna()
    out = staged(whole.mapInPandas(_integers(scale), "vec_id long, label long, vec binary, norm double"), "vectors")
    twice = staged(out.groupBy("vec_id").count().filter("count > 1").select("vec_id"), "vector-ids")
    if twice.isEmpty():
        return out
    one = out.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vec", "norm")).alias("r")).select(
        "vec_id", "r.*")
    return staged(out.join(twice, "vec_id", "left_anti").unionByName(one), "vectors")


def _matrix(vecs: list[bytes], width: int) -> np.ndarray:
    """Integer vectors as the rows of a matrix, shorter ones filled up with zeros."""
    if all(len(v) == 4 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), dtype="<i4").reshape(len(vecs), width)
    out = np.zeros((len(vecs), width), dtype=np.int32)
    for row, v in zip(out, vecs):
        row[:len(v) // 4] = np.frombuffer(v, dtype="<i4")
    return out


def _kind(limit: float):
    """Number type in which products of norms up to ``limit`` are exact: the sums of a product never exceed it."""
    return np.float32 if limit < 2 ** 23 else np.float64 if limit < 2 ** 52 else np.int64


# ---- trees -----------------------------------------------------------------

def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree (Prim): parent (-1 at the root), depth, and length of the edge to the parent, of each row."""
    v = vectors.astype(np.float64)
    sq = (v * v).sum(axis=1)
    near = np.maximum(sq[:, None] + sq[None] - 2 * (v @ v.T), 0)
    root = int(np.argmin(np.sqrt(near).sum(axis=1)))
    n = len(v)
    parent, depth, edge = np.full(n, -1), np.zeros(n, dtype=np.int64), np.zeros(n)
    best, via, left = near[root].copy(), np.full(n, root), np.ones(n, dtype=bool)
    left[root] = False
    for _ in range(n - 1):
        i = int(np.argmin(np.where(left, best, np.inf)))
        left[i] = False
        parent[i], depth[i] = via[i], depth[via[i]] + 1
        d = v[i] - v[via[i]]
        edge[i] = np.sqrt(d @ d)
        closer = left & (near[i] < best)
        best[closer], via[closer] = near[i][closer], i
    return parent, depth, edge


def _tree_udf(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        first, held = TaskContext.get().partitionId() << 32, []

        def tree(df: pd.DataFrame, nth: int) -> pd.DataFrame:
            vecs = df["vec"].tolist()
            parent, depth, edge = spanning_tree(_matrix(vecs, max(map(len, vecs)) // 4))
            return df.assign(chunk=first + nth, pos=np.arange(len(df)), parent=parent, depth=depth, edge=edge)

        nth = 0
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= chunk:
                rows = pd.concat(held, ignore_index=True)
                yield tree(rows.iloc[:chunk].reset_index(drop=True), nth)
                held, nth = [rows.iloc[chunk:]], nth + 1
        if sum(map(len, held)):
            yield tree(pd.concat(held, ignore_index=True), nth)
    return run


def anchor_trees(anchors: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``anchors`` (vec_id, label, vec, norm) with chunk, pos, parent, depth and edge of their trees, staged.

    Rows are range-sorted by the signs of their first components, so that near and
    equal vectors share a chunk.
    """
    n = anchors.count()
    signs = F.pandas_udf(_signs, "long")
    ordered = anchors.withColumn("_signs", signs("vec")).repartitionByRange(max(1, -(-n // chunk)), "_signs", "vec_id")
    ordered = ordered.sortWithinPartitions("_signs", "vec_id").drop("_signs")
    return staged(ordered.mapInPandas(_tree_udf(chunk), "vec_id long, label long, vec binary, norm double, chunk long, "
                                      "pos int, parent int, depth int, edge double"), "anchors")


def _signs(vecs: pd.Series) -> pd.Series:
    first = _matrix([v[:128] for v in vecs], 32)
    return pd.Series((first >= 0) @ (np.int64(1) << np.arange(32)), dtype="int64")


# ---- search ----------------------------------------------------------------

class _Tops:
    """The best ``k`` (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), np.iinfo(np.int64).min)
        self.id = np.full((slots, k), np.iinfo(np.int64).max)
        self.n = np.zeros(slots, dtype=np.int64)

    def least(self) -> np.ndarray:
        """Score that a newcomer must reach; the least integer where there is room."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[slot, -1]) | (ids < self.id[slot, -1])
        slot, score, ids = slot[better], score[better], ids[better]
        if not len(slot):
            return
        touched = np.unique(slot)
        held = np.arange(self.k)[None] < self.n[touched, None]
        slot = np.concatenate([np.repeat(touched, self.n[touched]), slot])
        score = np.concatenate([self.score[touched][held], score])
        ids = np.concatenate([self.id[touched][held], ids])
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        start = np.searchsorted(slot, touched)
        place = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        keep = place < self.k
        self.score[slot[keep], place[keep]] = score[keep]
        self.id[slot[keep], place[keep]] = ids[keep]
        self.n[touched] = np.minimum(np.diff(np.append(start, len(slot))), self.k)

    def rows(self, anchor_ids: np.ndarray, per_anchor: int) -> pd.DataFrame:
        slot, place = np.nonzero(np.arange(self.k)[None] < self.n[:, None])
        return pd.DataFrame({"anchor_id": anchor_ids[slot // per_anchor], "slot": (slot % per_anchor).astype(np.int32),
                             "vec_id": self.id[slot, place], "score": self.score[slot, place]})


def tree_scores(rows: np.ndarray, norms: np.ndarray, anchors: np.ndarray, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray,
                wanted) -> tuple[np.ndarray, np.ndarray]:
    """Exact scores of ``rows`` against each anchor where ``wanted(columns, low, high)`` says that the bounds matter.

    Returns (scores, known), both rows x anchors.  Bounds go down the tree level by
    level; a level whose rows nearly all matter is one matrix product.
    """
    kind = rows.dtype if rows.dtype != np.int64 else np.float64
    slack = 1.0 if kind == np.float32 else 1.0 + 2.0 ** -40 * float(norms.max(initial=0)) * float(np.abs(anchors).max(initial=1)) * anchors.shape[1]
    n, m = len(rows), len(anchors)
    low, high = np.empty((n, m), dtype=kind), np.empty((n, m), dtype=kind)
    scores, known = np.zeros((n, m), dtype=rows.dtype), np.zeros((n, m), dtype=bool)
    for d in range(int(depth.max()) + 1):
        cols = np.flatnonzero(depth == d)
        if d == 0:
            need = np.ones((n, len(cols)), dtype=bool)
        else:
            reach = (norms[:, None] * edge[cols][None]).astype(kind) + kind.type(slack)
            low[:, cols], high[:, cols] = low[:, parent[cols]] - reach, high[:, parent[cols]] + reach
            need = wanted(cols, low[:, cols], high[:, cols])
        if need.mean() > 0.1:
            at = np.flatnonzero(need.any(axis=1))
            at = slice(None) if len(at) > 0.8 * n else at
            got = rows[at] @ anchors[cols].T
            where = np.ix_(np.arange(n)[at], cols)
            scores[where] = low[where] = high[where] = got
            known[:, cols] = need
        else:
            for j in np.flatnonzero(need.any(axis=0)):
                at, c = np.flatnonzero(need[:, j]), cols[j]
                scores[at, c] = low[at, c] = high[at, c] = rows[at] @ anchors[c]
                known[at, c] = True
    return scores, known


def _blocks(anchors: pd.DataFrame, rows: pd.DataFrame):
    """(anchors of a chunk in tree order, their matrix, rows' matrix) for each chunk, in a number type that is exact."""
    width = max(len(v) for v in [*anchors["vec"], *rows["vec"]]) // 4
    x = _matrix(rows["vec"].tolist(), width)
    kind = _kind(float(rows["norm"].max()) * float(anchors["norm"].max()) + 1)
    x = x.astype(kind)
    for _, c in anchors.groupby("chunk", sort=True):
        c = c.sort_values("pos")
        yield c, _matrix(c["vec"].tolist(), width).astype(kind), x


def _slices(n: int) -> Iterator[slice]:
    at, size = 0, 256
    while at < n:
        yield slice(at, min(n, at + size))
        at, size = at + size, min(SLICE, 4 * size)


def _positives_in(k: int):
    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [_empty()]
        if len(anchors) and len(rows):
            ids, labels, norms = (rows[c].to_numpy() for c in ("vec_id", "label", "norm"))
            for c, a, x in _blocks(anchors, rows):
                own, label = c["vec_id"].to_numpy(), c["label"].to_numpy()
                tops = _Tops(len(c), k)
                for s in _slices(len(x)):
                    least = tops.least().astype(np.float64)
                    want = lambda cols, low, high: (high >= least[cols][None]) & (labels[s][:, None] == label[cols][None])
                    score, known = tree_scores(x[s], norms[s], a, c["parent"].to_numpy(), c["depth"].to_numpy(), c["edge"].to_numpy(), want)
                    r, j = np.nonzero(known & (score >= least[None]) & (labels[s][:, None] == label[None]) & (ids[s][:, None] != own[None]))
                    tops.add(j, score[r, j].astype(np.int64), ids[s][r])
                out.append(tops.rows(own, 1))
        return pd.concat(out, ignore_index=True)
    return run


def _negatives_in(k: int, window: tuple[int, int]):
    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [_empty()]
        if len(anchors) and len(rows):
            ids, labels, norms = (rows[c].to_numpy() for c in ("vec_id", "label", "norm"))
            for c, a, x in _blocks(anchors, rows):
                own, label = c["vec_id"].to_numpy(), c["label"].to_numpy()
                width = max(map(len, c["scores"]))
                if not width:
                    continue
                floor, roof = np.full((len(c), width), 2.0 ** 62), np.full((len(c), width), -2.0 ** 62)
                for i, scores in enumerate(c["scores"]):
                    for j, p in enumerate(map(int, scores)):
                        floor[i, j], roof[i, j] = -(-window[0] * p // 100), window[1] * p // 100
                tops = _Tops(len(c) * width, k)
                for s in _slices(len(x)):
                    least = np.maximum(floor, tops.least().reshape(len(c), width))
                    lowest, highest = np.where(floor <= roof, least, np.inf).min(axis=1), roof.max(axis=1)
                    want = lambda cols, low, high: ((high >= lowest[cols][None]) & (low <= highest[cols][None])
                                                    & (labels[s][:, None] != label[cols][None]))
                    score, known = tree_scores(x[s], norms[s], a, c["parent"].to_numpy(), c["depth"].to_numpy(), c["edge"].to_numpy(), want)
                    known &= labels[s][:, None] != label[None]
                    for w in range(width):
                        r, j = np.nonzero(known & (score >= least[:, w][None]) & (score <= roof[:, w][None]))
                        tops.add(j * width + w, score[r, j].astype(np.int64), ids[s][r])
                out.append(tops.rows(own, width))
        return pd.concat(out, ignore_index=True)
    return run


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"anchor_id": np.empty(0, np.int64), "slot": np.empty(0, np.int32), "vec_id": np.empty(0, np.int64),
                         "score": np.empty(0, np.int64)})


def _meet(rows: DataFrame, trees: DataFrame, run, row_shares: int, anchor_shares: int) -> DataFrame:
    """``run`` over every (share of the rows, share of the anchors): a stated query set against all rows, in blocks."""
    own = F.pmod(F.xxhash64("vec_id"), F.lit(row_shares)).cast("int")
    left = trees.withColumn("_a", F.pmod(F.xxhash64("chunk"), F.lit(anchor_shares)).cast("int")).withColumn(
        "_r", F.explode(F.sequence(F.lit(0), F.lit(row_shares - 1))))
    right = rows.withColumn("_r", own).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(anchor_shares - 1))))
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r")).applyInPandas(run, _FOUND)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = WINDOW, chunk: int = CHUNK, share_bytes: int = SHARE_BYTES) -> DataFrame:
    """Hard negatives of each anchor and positive among ``rows`` (vec_id, label, embedding).

    A score is the integer inner product of the vectors floor(scale * x).  An anchor's
    positives are its first ``positives`` other rows of its label; the negatives of a
    positive are the first ``negatives`` rows of other labels with scores of
    ``window`` per cent of the positive's.  Higher scores come first, then smaller
    vec_ids.  ``is_anchor``: a condition on vec_id and label.  Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows with a null vec_id, label or vector, a null or non-finite component, or a squared
    norm of 2^62 and more after scaling (their scores may not fit a long) take no
    part.  Shorter vectors count as filled up with zeros; an empty vector scores 0.  Of rows with one
    vec_id, that with the smallest label and vector counts.  A positive whose score is
    negative has an empty window.  An empty table gives an empty result.  Other
    columns are not read.
    """
    spark = rows.sparkSession
    vectors = integer_rows(rows, scale)
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("w")).first()
    if not size["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
                                         "negative_score long")
    trees = anchor_trees(vectors.filter(is_anchor), chunk)
    wide = max(64, size["w"])
    row_shares = max(-(-size["n"] * wide // share_bytes), min(16, -(-size["n"] // SLICE)))
    anchor_shares = max(1, -(-trees.count() * wide // share_bytes))
    best = staged(_first(_meet(vectors, trees, _positives_in(positives), row_shares, anchor_shares), ["anchor_id"], positives).select(
        "anchor_id", "vec_id", "score", "rank"), "positives")
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p")).select(
        F.col("anchor_id").alias("vec_id"), F.col("p.score").alias("scores"))
    # an anchor without positives still holds its place in the tree
    asked = trees.join(lists, "vec_id", "left").withColumn("scores", F.coalesce("scores", F.array().cast("array<long>")))
    found = _meet(vectors, staged(asked, "asked"), _negatives_in(negatives, window), row_shares, anchor_shares)
    kept = _first(found, ["anchor_id", "slot"], negatives)
    return kept.join(best.select(F.col("anchor_id").alias("_id"), (F.col("rank") - 1).alias("_slot"), F.col("vec_id").alias("positive_id"),
                                 F.col("score").alias("positive_score")),
                     (F.col("anchor_id") == F.col("_id")) & (F.col("slot") == F.col("_slot"))).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

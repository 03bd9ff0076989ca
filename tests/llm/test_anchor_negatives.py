"""Hard negatives against brute force, and the bounds of the tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import trajectra.llm.anchor_negatives as A

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                     T.StructField("label", T.IntegerType()), T.StructField("score", T.IntegerType())])


def brute(rows, every, scale=256):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) >= 2 ** 62:
            continue
        kept.setdefault(i, []).append((label, q))
    kept = {i: min(c, key=lambda c: (c[0], np.array(c[1], "<i4").tobytes())) for i, c in kept.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a, (label, q) in kept.items():
        if a % every:
            continue
        scored = sorted(((dot(q, p), i, lab) for i, (lab, p) in kept.items()), key=lambda x: (-x[0], x[1]))
        for s, i, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            near = [x for x in scored if x[2] != label and 50 * s <= 100 * x[0] <= 95 * s][:3]
            out |= {(a, i, r, n, s, t) for r, (t, n, _) in enumerate(near, 1)}
    return out


def made(n=240, dim=12, seed=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centre[rng.integers(6)] + rng.normal(size=dim) * 0.3
        if i % 7 == 3:
            v = centre[0]                          # many equal vectors: ties
        rows.append((i, [float(np.float32(x)) for x in v / 4], int(rng.integers(3))))
    return rows


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, 7) for r in rows], ROWS)


def got(df, every, **options):
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    rows = [tuple(r[c] for c in cols) for r in A.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(frame):
    rows = made()
    want = brute(rows, 8)
    assert want and got(frame(rows), 8) == want
    # small chunks and shares: many trees and blocks
    assert got(frame(rows), 8, chunk=5, share_bytes=3_000) == want


def test_odd_rows(frame):
    rows = made(80)
    rows += [(1000, None, 1), (1008, rows[0][1], None), (None, rows[0][1], 1), (1016, [float("nan")] * 12, 1), (1024, [float("inf")] * 12, 1),
             (1032, [None] + rows[1][1][1:], 1), (1040, [3e9] * 12, 1), (1048, rows[2][1][:5], 1), (1056, [], 2), (1064, [0.0] * 12, 0),
             (8, rows[3][1], 0), (8, rows[3][1], 0), (1072, [-x for x in rows[0][1]], 1), (1080, [900.0, -900.0] * 6, 0), (1081, [901.0, -900.0] * 6, 0)]
    assert got(frame(rows), 8) == brute(rows, 8)
    assert got(frame([]), 8) == set() and got(frame(rows[:1]), 8) == set()
    assert got(frame(rows), 100_000) == brute(rows, 100_000)


def test_number_types_are_exact():
    assert A._kind(2 ** 22) == np.float32 and A._kind(2 ** 40) == np.float64 and A._kind(2.0 ** 60) == np.int64


def test_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(40, 8)) * 100).astype(np.int32)
    v[5] = v[6]
    parent, depth, edge = A.spanning_tree(v)
    assert (parent == -1).sum() == 1 and all(depth[i] == depth[parent[i]] + 1 for i in range(40) if parent[i] >= 0)
    full = np.linalg.norm((v[:, None] - v[None]).astype(float), axis=2)
    total, seen = 0.0, {0}                          # another minimum spanning tree (Kruskal)
    parts = list(range(40))
    for d, i, j in sorted((full[i, j], i, j) for i in range(40) for j in range(i)):
        if parts[i] != parts[j]:
            old, total = parts[i], total + d
            parts = [parts[j] if p == old else p for p in parts]
    assert abs(edge.sum() - total) < 1e-6 and seen
    x = np.floor(rng.normal(size=(300, 8)) * 100)
    norms = np.linalg.norm(x, axis=1)
    exact = x @ v.T.astype(float)
    tops = exact.max(axis=0)
    score, known = A.tree_scores(x, norms, v.astype(float), parent, depth, edge, lambda c, low, high: high >= tops[c][None])
    assert (score[known] == exact[known]).all()
    assert known[exact.argmax(axis=0), np.arange(40)].all()      # what is looked for is never excluded


def test_tops_break_ties_by_id():
    t = A._Tops(2, 2)
    t.add(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 4, 3]))
    t.add(np.array([0, 0, 0]), np.array([5, 6, 5]), np.array([7, 8, 2]))
    assert t.rows(np.array([10, 20]), 1).values.tolist() == [[10, 0, 8, 6], [10, 0, 2, 5], [20, 0, 3, 1]]

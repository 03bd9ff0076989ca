"""Properties against brute force on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.operators import describe as D
from trajectra.operators import fit as FT


def test_percentiles_match_brute_force_with_a_hot_wave(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float(v)) for v in rng.normal(10, 3, 3000)]          # one wave holds most rows
    rows += [(w, float(v)) for w in (1, 2) for v in rng.integers(0, 20, 57)]
    df = spark.createDataFrame(rows, "wave int, y double").repartition(7)
    got = {(r["wave"], r["p"]): r["value"] for r in D.wave_percentiles(df).collect()}
    for w in (0, 1, 2):
        vals = sorted(v for ww, v in rows if ww == w)
        n = len(vals)
        for p in (0.2, 0.4, 0.5, 0.6, 0.8):
            k = max(1, math.floor(p * n + 0.5))
            assert got[(w, p)] == vals[k - 1]


def test_moments_match_numpy(spark):
    rng = np.random.default_rng(9)
    y = rng.gamma(2.0, 3.0, 500).round(1)
    df = spark.createDataFrame([(0, float(v)) for v in y], "wave int, y double")
    m = D.wave_moments(df).first()
    c = y - y.mean()
    assert m["variance"] == pytest.approx((c ** 2).mean())
    assert m["skewness"] == pytest.approx((c ** 3).mean() / (c ** 2).mean() ** 1.5)
    assert m["kurtosis"] == pytest.approx((c ** 4).mean() / (c ** 2).mean() ** 2 - 3)
    assert m["pct_min"] == pytest.approx(100.0 * (y == y.min()).mean())


def test_class_specific_intercept_step_never_worsens():
    rng = np.random.default_rng(3)
    for _ in range(20):
        A = rng.normal(size=(2, 2, 2))
        S = np.einsum("kab,kcb->kac", A, A) * 50 + np.eye(2) * 5
        n = rng.uniform(20, 200, 2)
        old = np.array([[[2.0, 0.3], [0.3, 1.0]], [[4.0, 0.3], [0.3, 1.0]]])
        th0 = np.array([2.0, 4.0, 0.3, 1.0])
        new = FT.ci_psi_step(S, n, old)
        th1 = np.array([new[0, 0, 0], new[1, 0, 0], new[0, 0, 1], new[0, 1, 1]])
        assert FT._ci_objective(th1, S, n) <= FT._ci_objective(th0, S, n) + 1e-9
        assert np.allclose(new[0, 0, 1], new[1, 0, 1]) and np.allclose(new[0, 1, 1], new[1, 1, 1])


def test_coverage_is_symmetric_and_bounded(spark):
    rows = [(i, *(float(i + t) if (i + t) % 3 else None for t in range(4))) for i in range(50)]
    wide = spark.createDataFrame(rows, "subject long, y_0 double, y_1 double, y_2 double, y_3 double")
    cov = D.coverage(wide, ["y_0", "y_1", "y_2", "y_3"]).collect()
    for r in cov:
        assert 0.0 <= r["coverage"] <= 1.0
        diag = {x["i"]: x["coverage"] for x in cov if x["i"] == x["j"]}
        assert r["coverage"] <= min(diag[r["i"]], diag[r["j"]]) + 1e-12
    assert D.missing_patterns(wide, ["y_0", "y_1", "y_2", "y_3"]).agg(F.sum("n")).first()[0] == 50


def test_moments_of_a_large_mean(spark):
    rng = np.random.default_rng(1)
    y = 1e9 + rng.gamma(2.0, 3.0, 2000)
    m = D.wave_moments(spark.createDataFrame([(0, float(v)) for v in y], "wave int, y double")).first()
    c = (y - 1e9) - (y - 1e9).mean()
    assert m["variance"] == pytest.approx((c ** 2).mean(), rel=1e-6)
    assert m["skewness"] == pytest.approx((c ** 3).mean() / (c ** 2).mean() ** 1.5, rel=1e-4)
    assert m["kurtosis"] == pytest.approx((c ** 4).mean() / (c ** 2).mean() ** 2 - 3, rel=1e-4)


def test_percentiles_through_the_bracket(spark):
    # more rows than the bracket's rounding: only the values inside the brackets are put in order
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(0, 1, 15_000), np.full(9_000, 0.25), rng.integers(0, 5, 6_000)])
    df = spark.createDataFrame([(0, float(v)) for v in y] + [(1, 1.0)], "wave int, y double").repartition(9)
    got = {(r["wave"], r["p"]): r["value"] for r in D.wave_percentiles(df).collect()}
    vals = sorted(y)
    for p in (0.2, 0.4, 0.5, 0.6, 0.8):
        assert got[(0, p)] == vals[max(1, math.floor(p * len(vals) + 0.5)) - 1]
        assert got[(1, p)] == 1.0


def test_missing_values_sort_last(spark):
    from trajectra.operators import panel as P
    df = spark.createDataFrame([(None, 1), (2, None), (1, 5), (2, 3), (None, None)], "a int, b int")
    assert [tuple(r) for r in P.sort_missing_last(df, ["a", "b"], [False, True]).collect()] == [
        (1, 5), (2, 3), (2, None), (None, 1), (None, None)]
    assert [tuple(r) for r in P.head(df, ["a", "b"], 2).collect()] == [(1, 5), (2, 3)]


def test_rank_starts_with_ties_and_null_keys(spark):
    from trajectra.operators.compare import rank_starts
    rows = [("a", 1.0), ("a", 1.0004), ("a", 0.5), ("a", None), (None, 3.0), (None, 2.0), ("b", 7.0)]
    r = {(x["m"], x["ll"]): (x["rank"], x["n_best"], x["best_replicated"])
         for x in rank_starts(spark.createDataFrame(rows, "m string, ll double"), ["m"]).collect()}
    assert r[("a", 1.0)] == r[("a", 1.0004)] == (1, 2, True) and r[("a", 0.5)][0] == 3 and r[("a", None)][0] == 4
    assert r[(None, 3.0)] == (1, 1, False) and r[(None, 2.0)][0] == 2 and r[("b", 7.0)] == (1, 1, False)

"""Fitters and scoring against a brute-force likelihood on our own panel.

The brute force writes every subject's covariance matrix out in full (Z Psi Z' +
diag(theta)) and evaluates the multivariate normal density; nothing is shared with
the closed forms under test.
"""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import PANEL_WAVES, made_panel
from trajectra.operators import fit as FT
from trajectra.operators import score as S

W = PANEL_WAVES
Y = [f"y_{t}" for t in range(W)]
T = np.arange(W)
Z = np.stack([np.ones(W), T, T * T], axis=1)
ROWS = np.array([[np.nan if v is None else v for v in r[1:]] for r in made_panel()])


def densities(p, rows=ROWS):
    """(subjects, classes) log density of each subject under each class, without the class share."""
    out = np.empty((len(rows), len(p["pi"])))
    for i, y in enumerate(rows):
        o = ~np.isnan(y)
        for k in range(len(p["pi"])):
            V = Z[o] @ p["psi"][k] @ Z[o].T + np.diag(np.broadcast_to(p["th"], W)[o])
            e = y[o] - Z[o] @ p["a"][k]
            out[i, k] = -0.5 * (o.sum() * math.log(2 * math.pi) + np.linalg.slogdet(V)[1] + e @ np.linalg.solve(V, e))
    return out


def loglik(p, rows=ROWS):
    lp = densities(p, rows) + np.log(p["pi"])
    top = lp.max(1)
    return float((top + np.log(np.exp(lp - top[:, None]).sum(1))).sum())


def stationary(p, ll, tolerance):
    """No small move of a mean, residual variance, random-effect variance or share raises the likelihood by more than ``tolerance``."""
    def moved(**new):
        return loglik({**p, **new})
    for k in range(len(p["pi"])):
        for j in range(3):
            if p["a"][k][j] != 0:
                for step in (-1e-3, 1e-3):
                    a = p["a"].copy()
                    a[k, j] += step
                    assert moved(a=a) <= ll + tolerance
    for t in (0, 4):
        for f in (0.995, 1.005):
            th = np.array(np.broadcast_to(p["th"], W))
            th[t] *= f
            if len(set(np.round(p["th"], 9))) > 1:
                assert moved(th=th) <= ll + tolerance
    for f in (0.99, 1.01):
        assert moved(psi=p["psi"] * f) <= ll + tolerance
    if len(p["pi"]) == 2:
        for d in (-0.005, 0.005):
            assert moved(pi=p["pi"] + np.array([d, -d])) <= ll + tolerance


@pytest.fixture(scope="module")
def fitted(wide_panel):
    return {r: FT.fit_em(wide_panel, Y, 2, r, n_starts=4, keep=2, seed=1, max_iter=300) for r in ("iq@0", "sq@0", " q@0", "c. i", "c.is")}


@pytest.mark.parametrize("restriction", ["iq@0", "sq@0", " q@0", "c. i", "c.is"])
def test_fitted_likelihood_is_the_brute_force_one_and_stationary(fitted, restriction):
    f = fitted[restriction]
    assert f["ll"] == pytest.approx(loglik(f["params"]), abs=1e-5)
    stationary(f["params"], f["ll"], 0.05)


def test_richer_restrictions_fit_no_worse(fitted):
    ll = {r: f["ll"] for r, f in fitted.items()}
    assert ll["iq@0"] <= ll["sq@0"] <= ll[" q@0"] + 0.1 and ll[" q@0"] <= ll["c. i"] + 0.3 and ll[" q@0"] <= ll["c.is"] + 0.3


def test_two_seeds_give_the_same_fit(wide_panel):
    a, b = (FT.fit_em(wide_panel, Y, 2, "sq@0", seed=s, tol=1e-8) for s in (3, 8))       # 100 starts, 20 kept
    assert round(a["ll"], 3) == round(b["ll"], 3)
    assert a["best_replicated"] and b["best_replicated"] and a["converged"]
    assert sorted(a["params"]["pi"])[0] == pytest.approx(0.2, abs=0.08)


def test_likelihood_never_falls(fitted):
    for f in fitted.values():
        hist = [h.max() for h in f["history"][10:]]
        assert all(b >= a - 1e-6 for a, b in zip(hist, hist[1:]))


def test_start_without_a_finite_likelihood_is_dropped(wide_panel):
    good = FT.start_values(wide_panel, Y, 2, 2, 5, (0, 1, 2), (0,))
    bad = {**good[1], "a": np.full((2, 3), np.nan)}
    f = FT.fit_em(wide_panel, Y, 2, "sq@0", start_params=[bad, good[0]], keep=2, max_iter=60)
    assert np.isfinite(f["ll"]) and not f["start_converged"][0]
    with pytest.raises(ValueError):
        FT.fit_em(wide_panel, Y, 2, "sq@0", start_params=[bad, bad], keep=2, max_iter=10)


def test_iteration_limit_shows(wide_panel):
    f = FT.fit_em(wide_panel, Y, 2, "sq@0", n_starts=2, keep=2, seed=1, max_iter=3, tol=1e-12)
    assert not f["converged"]


@pytest.mark.parametrize("factors,shared", [((0,), True), ((0, 1), False), ((0, 1), True), ((0, 1, 2), False)])
def test_growth_curves(wide_panel, factors, shared):
    f = FT.growth_curve(wide_panel, Y, factors, shared)
    p = {"a": f["a"][None], "th": f["th"], "psi": f["psi"][None], "pi": np.ones(1)}
    assert f["ll"] == pytest.approx(loglik(p), abs=1e-5) and f["converged"]
    stationary(p, f["ll"], 0.02)


def test_many_patterns_use_the_distributed_passes(wide_panel, monkeypatch):
    a = FT.growth_curve(wide_panel, Y, (0, 1), False)
    monkeypatch.setattr(FT, "MAX_PATTERNS", 3)
    b = FT.growth_curve(wide_panel, Y, (0, 1), False, max_iter=2000)
    assert a["ll"] == pytest.approx(b["ll"], abs=1e-3)


def test_growth_curve_over_25_waves(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *[float(10 + rng.normal()) if t < 3 + i % 22 else None for t in range(25)]) for i in range(200)]
    df = spark.createDataFrame(rows, "subject long, " + ", ".join(f"y_{t} double" for t in range(25)))
    f = FT.growth_curve(df, [f"y_{t}" for t in range(25)], (0, 1), True)
    assert np.isfinite(f["ll"]) and f["a"][0] == pytest.approx(10, abs=0.3)


def test_partial_sums_added_in_spark_or_on_the_driver_agree(wide_panel, monkeypatch):
    panel = FT.prepare_panel(wide_panel, Y)
    p = FT.start_values(wide_panel, Y, 2, 2, 5, (0, 1, 2), (0,))
    few = FT.em_pass(panel, Y, T, p)
    many = FT.em_pass(FT.Prepared(wide_panel.repartition(20), 20), Y, T, p)
    for key in few:
        np.testing.assert_allclose(few[key], many[key], rtol=1e-9, atol=1e-9)


def test_scoring_matches_brute_force(spark, wide_panel, fitted):
    f = fitted["c.is"]
    p = f["params"]
    params = FT.params_frame(spark, f, 2, W)
    post = S.class_posteriors(wide_panel, params, Y, K=2)
    got = {r["subject"]: r for r in post.collect()}
    d = densities(p)
    lp = d + np.log(p["pi"])
    share = np.exp(lp - lp.max(1)[:, None])
    share /= share.sum(1)[:, None]
    for i in range(len(ROWS)):
        r = got[i + 1]
        assert (r["logf_1"], r["logf_2"]) == pytest.approx(tuple(d[i]), abs=1e-8)
        assert r["post_1"] == pytest.approx(share[i, 0], abs=1e-9)
        assert r["most_likely"] == int(np.argmax(lp[i])) + 1
        o = ~np.isnan(ROWS[i])
        k = r["most_likely"] - 1
        V = Z[o] @ p["psi"][k] @ Z[o].T + np.diag(p["th"][o])
        b = p["psi"][k] @ Z[o].T @ np.linalg.solve(V, ROWS[i][o] - Z[o] @ p["a"][k])
        assert [r[f"b{a}_{k + 1}"] for a in range(3)] == pytest.approx(b.tolist(), abs=1e-7)
    sc = S.to_scores(post, 2)
    counts = {r["class"]: r["count"] for r in S.class_counts(sc).collect()}
    assert counts == {k + 1: int((lp.argmax(1) == k).sum()) for k in range(2)}
    e = 1 + (share * np.log(np.maximum(share, 1e-300))).sum() / (len(ROWS) * math.log(2))
    assert S.entropy(sc, 2).first()["entropy"] == pytest.approx(e, abs=1e-9)


def test_relabelling_classes_changes_nothing(spark, wide_panel, fitted):
    params = FT.params_frame(spark, fitted["sq@0"], 2, W)
    a, b = (S.class_posteriors(wide_panel, p, Y, K=2).agg(F.sum("ll")).first()[0]
            for p in (params, params.withColumn("class", 3 - F.col("class"))))
    assert a == pytest.approx(b, abs=1e-8) == pytest.approx(fitted["sq@0"]["ll"], abs=1e-6)


def test_scores_of_several_models_must_be_named(spark, wide_panel, fitted):
    one = FT.params_frame(spark, fitted["sq@0"], 2, W, "m1")
    two = one.unionByName(FT.params_frame(spark, fitted["iq@0"], 2, W, "m2"))
    sc = S.score(wide_panel, two, Y, K=2)
    assert S.attach_class(wide_panel, sc, "m2").count() == len(ROWS)
    with pytest.raises(Exception, match="several models"):
        S.attach_class(wide_panel, sc).collect()


def test_more_parameter_rows_than_the_broadcast_bound(spark, wide_panel, fitted, monkeypatch):
    params = FT.params_frame(spark, fitted["sq@0"], 2, W)
    want = S.class_posteriors(wide_panel, params, Y, K=2).agg(F.sum("ll")).first()[0]
    monkeypatch.setattr(S, "MAX_PARAM_ROWS", 0)
    assert S.class_posteriors(wide_panel, params, Y, K=2).agg(F.sum("ll")).first()[0] == pytest.approx(want)


def test_session_settings_are_left_alone(spark, wide_panel, fitted):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    sc = S.to_scores(S.class_posteriors(wide_panel, FT.params_frame(spark, fitted["sq@0"], 2, W), Y, K=2), 2)
    assert sc.where(F.col("class") == F.col("most_likely")).count() == len(ROWS)
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == before


def test_least_squares_keeps_its_digits(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = 1e9 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    r = FT.ols(df, "y", ["a", "b", "c"]).first()
    X = np.column_stack([np.ones(400), x])
    beta, *_ = np.linalg.lstsq(X, y - 1e9, rcond=None)
    res = y - 1e9 - X @ beta
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * (res @ res) / 396)
    assert [r[f"beta_{j}"] for j in range(1, 4)] == pytest.approx(beta[1:].tolist(), abs=1e-6)
    assert [r[f"se_{j}"] for j in range(4)] == pytest.approx(se.tolist(), rel=1e-5)
    assert r["t_1"] == pytest.approx(beta[1] / se[1], rel=1e-4)


@pytest.mark.parametrize("shared", [False, True])
def test_growth_curve_paths_agree_with_empty_subjects(spark, monkeypatch, shared):
    """Pattern sums on the driver and distributed passes give the same fit; subjects without any value change neither."""
    full = made_panel(60)
    cols = ", ".join(f"y_{w} double" for w in range(W))
    wide = spark.createDataFrame(full + [(1000 + i, *[None] * W) for i in range(20)], f"subject long, {cols}")
    alone = spark.createDataFrame(full, f"subject long, {cols}")
    start = {"a": np.array([[26.0, -0.2, 0.0]]), "th": np.full(W, 4.0), "psi": np.diag([4.0, 0.1, 0.0])[None], "pi": np.ones(1)}
    one = FT.growth_curve_steps(wide, Y, start, 3, (0, 1), shared)
    n = FT.growth_curve(wide, Y, (0, 1), shared, max_iter=3)["n"]
    monkeypatch.setattr(FT, "MAX_PATTERNS", 0)
    for panel in (wide, alone):
        two = FT.growth_curve_steps(panel, Y, start, 3, (0, 1), shared)
        assert one[1] == pytest.approx(two[1], rel=1e-10)
        for key in ("a", "th", "psi"):
            assert np.allclose(one[0][key], two[0][key], rtol=1e-8, atol=1e-8)
    assert n == FT.growth_curve(wide, Y, (0, 1), shared, max_iter=3)["n"] == 60


def test_extrapolation_to_no_residual_variance_is_not_believed():
    """Log variances almost in a line: the extrapolation falls far past the maximum (-3), where rounding makes the likelihood huge."""
    def em(p):
        x = float(np.log(p["th"][0]))
        return ({**p, "th": np.exp([max(x - 0.1 - 0.001 * x, -3.0)])}, -(x + 3) ** 2) if x > -3.5 else ({**p, "th": np.array([1e-6])}, 1e6)

    start = {"a": np.ones((1, 3)), "th": np.ones(1), "psi": np.zeros((1, 3, 3)), "pi": np.ones(1)}
    step = lambda ps: ([em(p)[0] for p in ps], np.array([em(p)[1] for p in ps]))
    (p,), _, settled = FT.squarem(step, [start], 1, 1, (0, 1, 2), (), 200, 1e-7, [])
    assert settled[0] and np.log(p["th"][0]) == pytest.approx(-3.0, abs=1e-3)

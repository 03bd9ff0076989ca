"""Scores, information and the class-count test against numerical derivatives and simulation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import PANEL_WAVES, made_panel
from tests.test_fit import ROWS, loglik
from trajectra.operators import grid_fit as GF
from trajectra.operators import information as IN

W = PANEL_WAVES
MODELS = [GF.Model("a", "one", 2, "sq@0"), GF.Model("b", "one", 2, "c. i", shared_residual=True), GF.Model("c", "one", 2, "c.is"),
          GF.Model("d", "one", 3, "iq@0", shared_residual=True), GF.Model("e", "one", 1, None, factors=(0, 1))]


def params(m, seed=1):
    rng = np.random.default_rng(seed)
    a = np.zeros((m.classes, 3))
    a[:, 0] = 24 + 2 * np.arange(m.classes)
    a[:, 1] = rng.normal(0, 0.3, m.classes)
    if 2 in m.factors:
        a[:, 2] = rng.normal(0, 0.02, m.classes)
    psi = np.zeros((m.classes, 3, 3))
    for ks, r, c in IN._psi_slots(m):
        x = rng.uniform(1, 2) if r == c == 0 else rng.uniform(0.2, 0.4) if r == c else 0.1
        for k in ks:
            psi[k][r, c] = psi[k][c, r] = x
    th = np.full(W, 1.7) if m.shared_residual else rng.uniform(1, 3, W)
    pi = rng.dirichlet(np.full(m.classes, 5.0))
    return {"a": a, "th": th, "psi": psi, "pi": pi}


@pytest.fixture(scope="module")
def panels(wide_panel):
    long = wide_panel.unpivot(["subject"], [f"y_{t}" for t in range(W)], "v", "y").select(
        F.lit("one").alias("outcome"), "subject", F.substring("v", 3, 2).cast("int").alias("wave"), "y")
    return GF.stage_panels(long)


def flat(rows):
    seen = [np.flatnonzero(~np.isnan(r)) for r in rows]
    return GF.flatten(seen, [r[o] for r, o in zip(rows, seen)], np.ones(len(rows)))


@pytest.mark.parametrize("m", MODELS, ids=lambda m: m.name)
def test_scores_are_the_derivatives(m):
    p, rows = params(m), ROWS[:12]
    x = IN.to_free(m, p)
    assert len(x) == len(IN.parameter_names(m, W)) == GF.count_parameters(m.classes, m.factors, m.restriction, m.shared_residual, W)
    back = IN.from_free(m, x, W)
    assert all(np.allclose(back[k], p[k]) for k in p)
    got = IN.scores(flat(rows), m, p)
    for i, row in enumerate(rows):
        for j in range(len(x)):
            h = 1e-5 * max(1.0, abs(x[j]))
            up, down = x.copy(), x.copy()
            up[j] += h
            down[j] -= h
            d = (loglik(IN.from_free(m, up, W), row[None]) - loglik(IN.from_free(m, down, W), row[None])) / (2 * h)
            assert got[i, j] == pytest.approx(d, abs=2e-5 * max(1.0, abs(d)))


def test_information_is_the_second_derivative(panels):
    m = MODELS[0]
    p = params(m)
    got = IN.information(panels, [[(m, p)]])[0]
    x = IN.to_free(m, p)
    s = IN.scores(flat(ROWS), m, p)
    assert np.allclose(got["B"], s.T @ s) and np.allclose(got["score"], s.sum(0))
    total = IN.score_products(panels, [[(m, p)], [(MODELS[1], params(MODELS[1]))]])
    assert np.allclose(total[0][1], s.T @ s)
    for i, j in ((0, 0), (0, 4), (6, 6), (7, 7), (6, 9), (len(x) - 1, len(x) - 1), (1, len(x) - 1)):
        hi, hj = (3e-4 * max(1.0, abs(x[k])) for k in (i, j))

        def at(a, b):
            y = x.copy()
            y[i] += a
            y[j] += b
            return loglik(IN.from_free(m, y, W))
        d = (at(hi, hj) - at(hi, -hj) - at(-hi, hj) + at(-hi, -hj)) / (4 * hi * hj)
        assert got["H"][0][i, j] == pytest.approx(-d, rel=2e-3, abs=0.05)


def test_errors_of_a_normal_mean_and_variance(spark):
    """One class, intercept only, one wave: everything is known in closed form."""
    rng = np.random.default_rng(4)
    y = rng.normal(5, 2, 400) ** 2
    p = GF.stage_panels(spark.createDataFrame([("o", i, 0, float(v)) for i, v in enumerate(y)], "outcome string, subject int, wave int, y double"))
    m = GF.Model("m", "o", 1, "iq@0", factors=(0,), shared_residual=True)
    f = GF.fit_grid(p, [m], n_starts=1, keep=1)
    rows = {r.parameter: r for r in IN.error_table(spark, p, f).collect()}
    s2, n = y.var(), len(y)
    m3, m4 = ((y - y.mean()) ** 3).mean(), ((y - y.mean()) ** 4).mean()
    assert rows["i_1"].est == pytest.approx(y.mean(), rel=1e-5) and rows["theta"].est == pytest.approx(s2, rel=1e-5)
    assert rows["i_1"].se == pytest.approx(np.sqrt(s2 / n), rel=1e-4) and rows["i_1"].se_robust == pytest.approx(np.sqrt(s2 / n), rel=1e-3)
    assert rows["theta"].se == pytest.approx(np.sqrt(2 * s2 ** 2 / n), rel=1e-4)
    assert rows["theta"].se_robust == pytest.approx(np.sqrt((m4 - s2 ** 2) / n), rel=1e-3)
    assert rows["theta"].scaling == pytest.approx((1 + (m4 / s2 ** 2 - 1) / 2) / 2, rel=1e-3) and abs(m3) > 0
    assert rows["i_1"].z == pytest.approx(rows["i_1"].est / rows["i_1"].se_robust)


def test_errors_need_a_positive_definite_information():
    assert IN.errors(np.eye(2), np.diag([1.0, -1.0]))["se"] is None


def test_weighted_chi_square():
    rng = np.random.default_rng(2)
    from math import exp
    for x in (0.5, 3.0, 9.0):
        assert IN.weighted_chi2_upper(x, np.ones(2)) == pytest.approx(exp(-x / 2), abs=1e-4)
        assert IN.weighted_chi2_upper(3 * x, 3 * np.ones(2)) == pytest.approx(exp(-x / 2), abs=1e-4)
    w = np.array([3.0, 1.5, 0.4, -0.3])
    draws = rng.chisquare(1, (400_000, 4)) @ w
    for x in (0.0, 4.0, 12.0):
        assert IN.weighted_chi2_upper(x, w) == pytest.approx((draws > x).mean(), abs=4e-3)


def test_reference_distribution_of_nested_models(panels):
    """A larger model that is right has weights of 1 for its extra parameters and 0 else; the class-count test has the test's mean."""
    one = GF.Model("1", "one", 1, "iq@0", shared_residual=True)
    two = GF.Model("2", "one", 2, "iq@0", shared_residual=True)
    fits = GF.fit_grid(panels, [one, two], n_starts=6, keep=2, seed=3, max_iter=200)
    rng = np.random.default_rng(8)
    made = []
    p = fits[1]["params"]
    for i in range(3000):
        k = rng.choice(2, p=p["pi"])
        made += [("one", i, t, float(v)) for t, v in enumerate(p["a"][k] @ np.array([np.ones(W), np.arange(W), np.arange(W) ** 2])
                                                               + rng.normal(0, np.sqrt(p["th"][0]), W))]
    spark = panels.table.sparkSession
    right = GF.stage_panels(spark.createDataFrame(made, "outcome string, subject int, wave int, y double"))
    free = GF.Model("f", "one", 2, "iq@0")
    a, b = GF.fit_grid(right, [free, two], n_starts=4, keep=2, seed=3, max_iter=200)
    weights = IN.reference_distribution(IN.information(right, [[(free, a["params"]), (two, b["params"])]])[0])
    assert weights[:W - 1] == pytest.approx(np.ones(W - 1), abs=0.25) and np.abs(weights[W - 1:]).max() < 0.2
    row = IN.class_count_tests(spark, panels, fits).collect()[0]
    assert row.lrt == pytest.approx(2 * (fits[1]["ll"] - fits[0]["ll"])) and row.dp == 4 and 0 <= row.p_value <= row.p_adjusted <= 1
    assert row.p_value < 0.01 and loglik(p) == pytest.approx(fits[1]["ll"], abs=1e-5) and len(made_panel()) == row.n

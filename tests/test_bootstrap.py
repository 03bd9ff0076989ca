"""Bootstrapped class-count test on panels with a known number of classes."""

import numpy as np
import pytest

from tests.conftest import PANEL_WAVES
from trajectra.operators import bootstrap as BS
from trajectra.operators import grid_fit as GF

W = PANEL_WAVES


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        a = (10.0, -0.8, 0.0) if i % 3 == 0 else (14.0, 0.4, 0.0)
        for t in range(W):
            if t < 3 or rng.random() < 0.8:
                rows.append(("o", i, t, float(a[0] + a[1] * t + rng.normal(0, 1.5))))
    return GF.stage_panels(spark.createDataFrame(rows, "outcome string, subject int, wave int, y double"))


@pytest.fixture(scope="module")
def fits(two_classes):
    models = [GF.Model(str(k), "o", k, "iq@0", shared_residual=True) for k in (1, 2, 3)]
    return GF.fit_grid(two_classes, models, n_starts=6, keep=2, max_iter=120)


def test_the_right_number_of_classes(spark, two_classes, fits):
    one, two, three = fits
    search = dict(draws=9, n_starts=3, keep=2, max_iter=45, tol=1e-6)
    a = BS.bootstrap_tests(spark, two_classes, [(two, one)], **search).collect()[0]
    b = BS.bootstrap_tests(spark, two_classes, [(three, two)], **search).collect()[0]
    assert a.p_value == pytest.approx(1 / (1 + a.successful_draws)) and a.successful_draws >= 8 and a.lrt > 100
    assert b.p_value > 0.15 and 0 < b.mean < 40
    assert BS.bootstrap_tests(spark, two_classes, []).collect() == []


def test_draws_follow_the_model_and_rerun_alike(two_classes, fits):
    two = fits[1]
    drawn = BS.simulated(two_classes, [two], 40, 3)
    rows = drawn.collect()
    key = lambda r: (r.outcome, r.subject)
    again = {key(r): r for r in BS.simulated(two_classes._replace(table=two_classes.table.repartition(7)), [two], 40, 3).collect()}
    assert len(rows) == 40 * 150 == len(again) and all(again[key(r)].y == r.y and again[key(r)].t == r.t for r in rows)
    seen = {r.subject: r.t for r in two_classes.table.collect()}
    assert all(seen[r.subject] == r.t for r in rows)                 # the observed waves of each subject
    p = two["params"]
    first = np.array([r.y[0] for r in rows])
    mean, var = p["pi"] @ p["a"][:, 0], p["th"][0] + p["pi"] @ p["a"][:, 0] ** 2 - (p["pi"] @ p["a"][:, 0]) ** 2
    assert first.mean() == pytest.approx(mean, abs=0.15) and first.var() == pytest.approx(var, rel=0.1)

"""The grid of models against single fits, brute force, weights and very uneven panels."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import PANEL_WAVES, made_panel
from tests.test_fit import ROWS, loglik, stationary
from trajectra.operators import fit as FT
from trajectra.operators import grid_fit as GF
from trajectra.plans.q_grid import m6_grid_fit

W = PANEL_WAVES
Y = [f"y_{t}" for t in range(W)]


@pytest.fixture(scope="module")
def long_panel(wide_panel):
    long = wide_panel.unpivot(["subject"], Y, "v", "y").select(
        F.lit("one").alias("outcome"), "subject", F.substring("v", 3, 2).cast("int").alias("wave"), "y")
    half = long.where("subject % 2 = 0").withColumn("outcome", F.lit("half")).withColumn("y", F.col("y") + 3)
    return long.unionByName(half).cache()


@pytest.fixture(scope="module")
def panels(long_panel):
    return GF.stage_panels(long_panel)


def test_kernel_equals_the_wide_one():
    rng = np.random.default_rng(3)
    rows = ROWS[:60]
    p = {"a": np.array([[25.0, -0.5, 0.02], [20.0, 0.3, 0.0]]), "th": rng.uniform(1, 3, W), "pi": np.array([0.3, 0.7]),
         "psi": np.stack([np.array([[3.0, 0.2, 0], [0.2, 0.4, 0], [0, 0, 0]]), np.array([[1.0, -0.1, 0], [-0.1, 0.3, 0], [0, 0, 0]])])}
    seen = [np.flatnonzero(~np.isnan(r)) for r in rows]
    v = GF.flatten(seen, [r[o] for r, o in zip(rows, seen)], np.ones(len(rows)))
    ll, post, b, D = FT.estep_batch(rows, FT.design(range(W)), p["a"], np.broadcast_to(p["th"], (2, W)), p["psi"], np.log(p["pi"]))
    e = GF.estep(v, p)
    assert np.allclose(e.ll, ll) and np.allclose(e.post, post) and np.allclose(np.stack(e.b, 1), b)
    want = FT.msums_batch(rows, FT.design(range(W)), post, b, D)
    got = GF._unpacked(GF.em_sums(v, p), 2, W)
    for key in ("sw", "sy", "syy", "sbb", "sp"):
        assert np.allclose(got[key][0], want[key])
    assert got["ll"] == pytest.approx(loglik(p, rows))


def test_every_model_reaches_its_own_maximum(panels):
    models = [GF.Model(f"{o} {k} {r} {s}", o, k, r, shared_residual=s) for o in ("one", "half")
              for k, r in ((1, "sq@0"), (2, "iq@0"), (2, "sq@0"), (2, "c.is")) for s in (False, True)]
    fits = {r["model"].name: r for r in GF.fit_grid(panels, models, n_starts=4, keep=2, max_iter=300, seed=1)}
    rows = {"one": ROWS, "half": ROWS[np.array([r[0] % 2 == 0 for r in made_panel()])] + 3}
    for m in models:
        f = fits[m.name]
        assert f["converged"] and f["n"] == len(rows[m.outcome])
        assert f["ll"] == pytest.approx(loglik(f["params"], rows[m.outcome]), abs=1e-5)
        stationary(f["params"], f["ll"], 0.05)
        assert sum(f["posterior_counts"]) == pytest.approx(f["n"]) and sum(f["likely_counts"]) == f["n"]
    # equal residual variances are a restriction of free ones
    assert all(fits[m.name]["ll"] <= fits[m.name.replace("True", "False")]["ll"] + 1e-6 for m in models)


def test_grid_equals_a_single_fit(panels, wide_panel):
    m = GF.Model("m", "one", 2, "sq@0")
    grid = GF.fit_grid(panels, [m, GF.Model("other", "half", 3, "iq@0")], n_starts=1, keep=1, max_iter=200)[0]
    start = GF.scaled_start(GF.unit_starts(2, 1, 7)[0], panels, m)
    alone = FT.fit_em(wide_panel, Y, 2, "sq@0", start_params=[start], keep=1, max_iter=200)
    assert grid["ll"] == pytest.approx(alone["ll"], abs=1e-6)
    steps = GF.grid_steps(panels, [m], 4)[0]
    assert steps["ll"] == pytest.approx(FT.em_steps(wide_panel, Y, "sq@0", [start], 4)[1][0], abs=1e-8)


def test_many_partitions_add_up_in_spark(panels, monkeypatch):
    m = [GF.Model("a", "one", 2, "sq@0"), GF.Model("b", "half", 1, "iq@0")]
    few = GF.grid_steps(panels, m, 3, 2)
    monkeypatch.setattr(GF, "FEW_PARTS", 0)
    for x, y in zip(few, GF.grid_steps(panels, m, 3, 2)):
        assert x["ll"] == pytest.approx(y["ll"], rel=1e-12) and np.allclose(x["params"]["a"], y["params"]["a"])


def test_equal_rows_as_weights(long_panel):
    rounded = long_panel.where("outcome = 'one' AND wave < 3").withColumn("y", F.round(F.col("y") / 4) * 4)
    models = [GF.Model("m", "one", 2, "iq@0", shared_residual=True)]
    one, two = GF.stage_panels(rounded), GF.stage_panels(rounded, collapse=True)
    assert two.table.count() < one.table.count() and one.n == two.n
    a, b = (GF.grid_steps(p, models, 5)[0] for p in (one, two))
    assert a["ll"] == pytest.approx(b["ll"], rel=1e-12)
    assert np.allclose(a["params"]["th"], b["params"]["th"]) and np.allclose(a["posterior_counts"], b["posterior_counts"])


def test_a_subject_with_very_many_visits(spark):
    """Neither columns nor expressions grow with the waves."""
    long = spark.range(100_000).select(F.lit("o").alias("outcome"), F.lit(0).alias("subject"), F.col("id").alias("wave"),
                                       (F.sin(F.col("id")) * 3 + 10).alias("y"))
    few = spark.range(60).select(F.lit("o").alias("outcome"), (1 + F.col("id") % 20).alias("subject"), (F.col("id") / 20).cast("long").alias("wave"),
                                 (F.col("id") % 7 + 5).cast("double").alias("y"))
    p = GF.stage_panels(long.unionByName(few))
    r = GF.grid_steps(p, [GF.Model("m", "o", 2, "sq@0", factors=(0,), shared_residual=True)], 3)[0]
    assert r["n"] == 21 and r["waves"] == 100_000 and np.isfinite(r["ll"])


def test_odd_rows(spark):
    rows = [("a", 1, 0, 2.0), ("a", 1, 1, None), ("a", 2, 0, 3.0), ("a", 3, None, 3.0), (None, 4, 0, 1.0), ("a", 5, 0, None), ("a", 2, 2, 4.0)]
    p = GF.stage_panels(spark.createDataFrame(rows, "outcome string, subject int, wave int, y double"))
    assert p.n == {"a": 2} and p.waves("a") == 3
    assert GF.grid_steps(p, [], 2) == []
    assert GF.stage_panels(spark.createDataFrame([], "outcome string, subject int, wave int, y double")).n == {}


def test_grid_query_searches_like_the_reference(spark, tmp_path, monkeypatch):
    """Every class number, restriction and residual rule, 100 starts of which 20 are carried on, 10 first steps, at most 500."""
    rng = np.random.default_rng(5)
    rows = [(100 * s + t, datetime(2024, 1, 1 + t), s, "a", float(8 * (s % 3) + t * (s % 2) + rng.normal(0, 1)))
            for s in range(60) for t in range(3 + s % 2)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    searches, inner = [], GF.starts_search

    def seen(params, K, W, factors, random, *search):
        searches.append((len(params), *search))
        return inner(params[:2], K, W, factors, random, 2, 1, 3, 1e-7)

    monkeypatch.setattr(GF, "starts_search", seen)
    out = m6_grid_fit(spark, str(tmp_path)).collect()
    assert len({(r["n_classes"], r["restriction"], r["residuals"]) for r in out}) == len(out) == 18
    assert searches == [(100, 20, 10, 500, 1e-7)] * 18 and all(r["n"] == 60 for r in out)


def test_very_many_parameter_sets_are_dealt_over_jobs(panels, monkeypatch):
    models = [GF.Model("a", "one", 2, "sq@0"), GF.Model("b", "half", 1, "iq@0"), GF.Model("c", "half", 3, "iq@0")]
    asked = [(m.outcome, GF.scaled_start(u, panels, m)) for m in models for u in GF.unit_starts(m.classes, 3, 1)]
    blocks, jobs, inner = GF.panel_blocks(panels), [], GF._em_job
    monkeypatch.setattr(GF, "_em_job", lambda p, b, some, scores: jobs.append(len(some)) or inner(p, b, some, scores))
    whole = GF.em_pass(panels, blocks, asked)
    monkeypatch.setattr(GF, "ASK_VALUES", 1)
    for x, y in zip(whole, GF.em_pass(panels, blocks, asked), strict=True):
        assert np.allclose(x, y, rtol=1e-9)
    monkeypatch.setattr(GF, "ASK_VALUES", 300)
    for x, y in zip(whole, GF.em_pass(panels, blocks, asked), strict=True):
        assert np.allclose(x, y, rtol=1e-9)
    assert jobs[0] == 9 and jobs[1:10] == [1] * 9 and sum(jobs[10:]) == 9 and 1 < len(jobs[10:]) < 9

"""Sums of blocks of subjects against each subject's own, and grids whose parameters stay in Spark."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import PANEL_WAVES
from trajectra.operators import fit as FT
from trajectra.operators import grid_fit as GF
from trajectra.plans import q_grid as QG
from trajectra.plans import q_scan as QS
from trajectra.sources import reports as RP

W = PANEL_WAVES
PSI = {"none": np.zeros((2, 3, 3)), "shared": np.tile(np.diag([3.0, 0.4, 0.0]), (2, 1, 1)),
       "own": np.stack([np.array([[3.0, 0.2, 0], [0.2, 0.4, 0], [0, 0, 0]]), np.array([[1.0, -0.1, 0], [-0.1, 0.3, 0], [0, 0, 0]])]),
       "one": np.stack([np.zeros((3, 3)), np.diag([2.0, 0.0, 0.1])])}


def made(n=300, waves=W, seed=5):
    rng = np.random.default_rng(seed)
    rows = rng.normal(500, 4, (n, waves))
    rows[rng.random((n, waves)) < 0.3] = np.nan
    rows[:, 0] = np.where(np.isnan(rows).all(1), 500.0, rows[:, 0])
    return rows, {"a": np.array([[497.0, -0.5, 0.02], [502.0, 0.3, 0.0]]), "th": rng.uniform(1, 3, waves), "pi": np.array([0.3, 0.7])}


@pytest.mark.parametrize("psi", PSI)
def test_block_sums_equal_the_subjects_own(psi):
    rows, p = made()
    Z = FT.design(range(W))
    ll, post, b, D = FT.estep_batch(rows, Z, p["a"], np.broadcast_to(p["th"], (2, W)), PSI[psi], np.log(p["pi"]))
    want = FT.msums_batch(rows, Z, post, b, D)
    got, got_ll, entropy = FT.block_sums(FT.wide_block(rows), Z, p["a"], p["th"], PSI[psi], p["pi"])
    parts = GF._unpacked(np.concatenate([got.ravel(), [got_ll, entropy]]), 2, W)
    for key in ("sw", "sy", "syy", "sbb", "sp"):
        assert np.allclose(parts[key][0], want[key])
    assert got_ll == pytest.approx(ll.sum()) and entropy == pytest.approx(-(post * np.log(post)).sum())
    assert parts["likely"].tolist() == np.bincount(post.argmax(1), minlength=2).tolist()


def test_repeated_waves_weights_and_uneven_subjects():
    rng = np.random.default_rng(2)
    t = [np.sort(rng.integers(0, 4, rng.integers(1, 6))) for _ in range(40)] + [np.array([0, 3, 399])]      # waves may come twice
    y = [rng.normal(20, 3, len(v)) for v in t]
    w = rng.integers(1, 4, len(t)).astype(float)
    p = {"a": np.array([[18.0, 0.1, 0.0], [22.0, -0.1, 0.0]]), "th": rng.uniform(5, 9, 400), "pi": np.array([0.4, 0.6]), "psi": PSI["own"]}
    v = GF.flatten(t, y, w)
    assert len(v.blocks) > 1
    s, got = GF.estep(v, p), GF._unpacked(GF.em_sums(v, p), 2, 400)
    assert got["ll"] == pytest.approx(w @ s.ll) and np.allclose(got["sp"][0], w @ s.post)
    for k in range(2):
        each = (s.post[:, k] * w)[v.r]
        rest = v.y - (v.powers[:, :3] * s.b[k][v.r]).sum(1)
        assert np.allclose(got["sy"][0][k], np.bincount(v.t, each * rest, 400))
        assert np.allclose(got["syy"][0][k], np.bincount(v.t, each * (rest * rest + GF._spread(s.D[k], v)), 400))
        assert np.allclose(got["sbb"][0][k], np.einsum("n,ni,nj->ij", s.post[:, k] * w, s.b[k], s.b[k]) + np.tensordot(s.post[:, k] * w, s.D[k], 1))


def test_effects_are_solved_once_a_pattern(monkeypatch):
    rows, p = made()
    rows[:, 5:] = np.nan
    rows[:, :5] = np.where(np.isnan(rows[:, :5]), 500.0, rows[:, :5])
    v = GF.flatten([np.arange(5)] * len(rows), list(rows[:, :5]), np.ones(len(rows)))
    solved, solve = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: (solved.append(len(a)), solve(a, b))[1])
    GF.em_sums(v, p | {"psi": PSI["shared"]})
    assert sum(solved) == 1


def test_em_pass_takes_fewer_steps_a_subject():
    rows, p = made(4000, 25)
    Z, psi = FT.design(range(25)), np.zeros((2, 3, 3))
    v, patterns = FT.wide_block(rows), FT.patterns_of(rows)

    def by_subject():
        _, post, b, D = FT.estep_batch(rows, Z, p["a"], np.broadcast_to(p["th"], (2, 25)), psi, np.log(p["pi"]), patterns)
        FT.msums_batch(rows, Z, post, b, D, patterns)

    def seconds(f):
        t = time.perf_counter()
        f()
        return time.perf_counter() - t
    assert min(seconds(lambda: FT.block_sums(v, Z, p["a"], p["th"], psi, p["pi"])) for _ in range(5)) < min(seconds(by_subject) for _ in range(5)) / 1.5


@pytest.fixture(scope="module")
def panel(wide_panel):
    long = wide_panel.unpivot(["subject"], [f"y_{t}" for t in range(W)], "v", "y").select(
        F.lit("one").alias("outcome"), "subject", F.substring("v", 3, 2).cast("int").alias("wave"), "y")
    few = long.where("subject % 20 = 1").withColumn("outcome", F.concat(F.lit("few"), F.col("subject") % 40))
    return long.unionByName(few).unionByName(long.withColumn("outcome", F.lit(None).cast("string"))).cache()


def test_grid_kept_in_spark_equals_the_driver_s(spark, panel, monkeypatch):
    monkeypatch.setattr(GF, "CHUNK_VALUES", 300)
    monkeypatch.setattr(GF, "FAN_IN", 3)
    specs = QG.specs(spark, classes=(1, 2), restrictions=("iq@0", "sq@0"))
    got = {r["model"]: r for r in GF.grid_steps_table(panel, specs, 3, 2).collect()}
    panels = GF.stage_panels(panel)
    want = {r["model"]: r for r in GF.grid_table(spark, GF.grid_steps(panels, GF.grid_models(specs, list(panels.n)), 3, 2)).collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 8
    for name, w in want.items():
        g = got[name]
        for c in ("outcome", "n_classes", "restriction", "residuals", "n", "waves", "parameters", "converged", "best_replicated", "best_start", "best_seed"):
            assert g[c] == w[c]
        assert g["ll"] == pytest.approx(w["ll"]) and (g["entropy"] == w["entropy"] or g["entropy"] == pytest.approx(w["entropy"]))
        assert [tuple(s)[1:] for s in g["starts"]] == [tuple(s)[1:] for s in w["starts"]]
        for a, b in zip(g["classes"], w["classes"], strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or x == pytest.approx(y, rel=1e-6, abs=1e-9)


def test_fixed_grid_brings_no_parameters_to_the_driver(spark, panel, monkeypatch):
    def no_pass(*_):
        raise AssertionError("parameters on the driver")
    monkeypatch.setattr(GF, "grid_pass", no_pass)
    assert QG.fixed_grid(spark, panel, 2, 1, classes=(1, 2), restrictions=("iq@0",), rules=(True,)).count() == 6
    empty = QG.fixed_grid(spark, panel.limit(0), 2, 1, classes=(1,), restrictions=("iq@0",), rules=(True,))
    assert empty.collect() == []


@pytest.mark.parametrize("psi", PSI)
@pytest.mark.parametrize("classes", (1, 2, 3))
def test_sums_of_many_groups_equal_those_of_each(psi, classes, monkeypatch):
    monkeypatch.setattr(FT, "TILE", 256)
    rows, _ = made(700)
    rows[:400, 4:] = np.nan                                            # a frequent pattern, and many rare ones
    rows[:400, :4] = np.where(np.isnan(rows[:400, :4]), 500.0, rows[:400, :4])
    rng = np.random.default_rng(classes)
    G, Z, own = 7, FT.design(range(W)), np.concatenate([PSI[psi], PSI[psi][:1]])[:classes]
    a, th, pi = rng.normal(0, 1, (G, classes, 3)) * [3, 0.4, 0.02] + [500, 0, 0], rng.uniform(1, 3, (G, W)), rng.dirichlet(np.full(classes, 4.0), G)
    scale = rng.uniform(0.5, 2.0, G)
    v = FT.wide_block(rows)
    for block in (v, v._replace(weight=rng.integers(1, 4, 700).astype(float))):
        got, ll, entropy = FT.grid_sums(FT.read_block(FT.written_block(block)), Z, a, th, scale[:, None, None, None] * own, pi)
        quick = FT.grid_sums(block, Z, a, th, scale[:, None, None, None] * own, pi, scores=False)
        for g in range(G):
            want, want_ll, want_entropy = FT.block_sums(block, Z, a[g], th[g], scale[g] * own, pi[g])
            assert np.allclose(got[g], want, rtol=1e-9, atol=1e-8) and ll[g] == pytest.approx(want_ll) and entropy[g] == pytest.approx(want_entropy, abs=1e-9)
        assert np.allclose(quick[0][..., :-1], got[..., :-1]) and np.allclose(quick[1], ll)


def test_repeated_waves_in_groups():
    rng = np.random.default_rng(4)
    v = GF.flatten([np.array([0, 1, 1, 3])] * 300, list(rng.normal(20, 3, (300, 4))), np.ones(300)).blocks[0]
    a, th, pi, psi = rng.normal(20, 1, (6, 2, 3)) * [1, 0.01, 0.001], rng.uniform(5, 9, (6, 4)), np.full((6, 2), 0.5), np.stack([PSI["own"]] * 6)
    got, ll, _ = FT.grid_sums(FT.read_block(FT.written_block(v)), FT.design(range(4)), a, th, psi, pi)
    for g in range(6):
        want, want_ll, _ = FT.block_sums(v, FT.design(range(4)), a[g], th[g], psi[g], pi[g])
        assert np.allclose(got[g], want) and ll[g] == pytest.approx(want_ll)


def test_subjects_are_laid_out_once_for_all_passes(spark, panel, wide_panel, monkeypatch):
    monkeypatch.setattr(FT, "BLOCK_CELLS", 1)
    Y = [f"y_{t}" for t in range(W)]
    prepared = FT.prepare_panel(wide_panel, Y)
    p = made()[1] | {"psi": PSI["shared"]}
    once, each = FT.em_pass(prepared, Y, range(W), [p] * 2), FT.em_pass(FT.Prepared(wide_panel.repartition(3), 3), Y, range(W), [p] * 2)
    assert prepared.blocks.columns == ["block"] and all(np.allclose(once[x], each[x]) for x in once)
    panels = GF.stage_panels(panel)
    asked = [("one", p), ("few1", p), ("one", p)]
    for x, y in zip(GF.em_pass(panels, GF.panel_blocks(panels), asked), GF.grid_pass(panels, asked), strict=True):
        assert np.allclose(x, y)


def test_report_folders_stand_on_a_fixed_number_of_shelves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(QS, "SHELVES", 5)
    rows = spark.range(40).select(F.concat(F.lit("m "), F.col("id").cast("string")).alias("report"), F.concat(F.lit("a\nb "), F.col("id")).alias("value"))
    path = f"{tmp_path}/reports"
    QS.report_writer(rows).text(path)
    assert len([x for x in os.listdir(path) if "=" in x]) <= 5
    lines = RP.scan_reports(spark, path, "*.txt").withColumn("path", F.regexp_extract("path", r"report=([^/]+)/", 1)).where("line_no = 2")
    assert {(r["path"], r["line"]) for r in lines.collect()} == {(f"m {i}", f"b {i}") for i in range(40)}


def test_subject_rows_are_made_in_tasks_of_bounded_size(panel, monkeypatch):
    want = {(r["outcome"], r["subject"]): (r["t"], r["y"]) for r in GF.subject_rows(panel).collect()}
    monkeypatch.setattr(GF, "GROUP_VALUES", 50)
    rows = GF.subject_rows(panel)
    values = panel.where("y IS NOT NULL AND wave IS NOT NULL AND outcome IS NOT NULL").count()
    assert rows.rdd.getNumPartitions() == values // 50 > 8
    assert {(r["outcome"], r["subject"]): (r["t"], r["y"]) for r in rows.collect()} == want


def test_blocks_leave_out_what_was_not_observed():
    rows, _ = made(2_000)
    rows[:, 4:] = np.nan
    rows[:5, 4:] = 500.0
    for block in (FT.wide_block(rows), FT.wide_block(rows)._replace(weight=np.full(2_000, 2.0))):
        written = FT.written_block(block)
        assert len(written) < 0.6 * (block.y.nbytes + block.weight.nbytes)
        for x, y in zip(FT.read_block(written), block, strict=True):
            assert np.array_equal(x, y)

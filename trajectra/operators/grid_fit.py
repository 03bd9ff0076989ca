"""Fitting a whole grid of growth models in the same passes (M6-M8 over J6).

A model is an outcome, a number of classes, a restriction, factors and a residual
rule; a grid is any number of them, over panels of several outcomes in one staged
table.  Every search (all starts of a model, with their own stopping) asks for EM
steps at some parameter sets; one pass over the table answers all searches that are
still going, and the driver keeps nothing but the parameters and their sums.

A subject is one row with its (wave, y) pairs in arrays, whatever the waves: neither
columns nor expressions grow with their number.  A pass lays the subjects of a batch
out in blocks by wave (very uneven ones by size) for its sums.  Equal rows can be collapsed to
one with a weight.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.operators.fit import (FEW_PARTS, LN2PI, PART_CELLS, RESTRICTION_SPEC, Block, block_of, count_parameters, design, grid_sums,
                                     mstep, read_block, starts_search, written_block)
from trajectra.operators.joins import checked_broadcast
from trajectra.session import ship_package, stage


class Model(NamedTuple):
    """One cell of a grid.  ``restriction`` None: one class, all ``factors`` random."""
    name: str
    outcome: str
    classes: int
    restriction: str | None
    factors: tuple[int, ...] = (0, 1, 2)
    shared_residual: bool = False

    @property
    def random(self) -> tuple[int, ...]:
        return tuple(self.factors) if self.restriction is None else RESTRICTION_SPEC[self.restriction][0]

    @property
    def per_class(self):
        return False if self.restriction is None else RESTRICTION_SPEC[self.restriction][1]


GROUP_VALUES = 100_000      # values a task of ``subject_rows`` takes in


class Panels(NamedTuple):
    """Staged panels: table (outcome, subject, t, y, weight), its partitions, and per outcome the mean and variance of each wave and n."""
    table: DataFrame
    parts: int
    mean: dict[str, np.ndarray]
    var: dict[str, np.ndarray]
    n: dict[str, int]

    def waves(self, outcome: str) -> int:
        return len(self.mean[outcome])


def stage_panels(panel: DataFrame, outcome: str = "outcome", subject: str = "subject", wave: str = "wave", y: str = "y",
                 collapse: bool = False) -> Panels:
    """One row per (outcome, subject) with its waves and values in arrays, staged and cached for the passes.

    Rows without outcome, wave or value take no part.  ``collapse``: subjects with
    equal arrays become one row whose weight is their number (one more exchange, by the
    arrays); posteriors and sums are the same.
    """
    return panels_of(subject_rows(panel, outcome, subject, wave, y, collapse))


def subject_rows(panel: DataFrame, outcome: str = "outcome", subject: str = "subject", wave: str = "wave", y: str = "y",
                 collapse: bool = False) -> DataFrame:
    """(outcome, subject, t, y, weight): see ``stage_panels``."""
    rows = panel.where(F.col(y).isNotNull() & F.col(wave).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.select(F.col(outcome).cast("string").alias("outcome"), F.col(subject).alias("subject"),
                       F.struct(F.col(wave).cast("int").alias("t"), F.col(y).cast("double").alias("y")).alias("v"))
    # set by hand, as a task holds many times the bytes that its exchange counts
    values = rows.count()
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, values // 2_000), values // GROUP_VALUES)
    rows = rows.repartition(parts, "outcome", "subject").groupBy("outcome", "subject").agg(F.sort_array(F.collect_list("v")).alias("v"))
    rows = rows.select("outcome", F.col("subject").cast("string").alias("subject"), F.col("v.t").alias("t"), F.col("v.y").alias("y"))
    if collapse:
        return rows.groupBy("outcome", "t", "y").agg(F.min("subject").alias("subject"), F.count(F.lit(1)).cast("double").alias("weight"))
    return rows.withColumn("weight", F.lit(1.0))


def panels_of(rows: DataFrame) -> Panels:
    """Panels of rows (outcome, subject, t, y, weight), one per subject."""
    table = stage(rows, "panels")
    cells = table.select("outcome", "weight", F.explode(F.arrays_zip("t", "y")).alias("v")).groupBy("outcome", F.col("v.t").alias("t")).agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("v.y")).alias("s1"), F.sum(F.col("weight") * F.col("v.y") * F.col("v.y")).alias("s2"))
    mean: dict[str, np.ndarray] = {}
    var: dict[str, np.ndarray] = {}
    for o, g in cells.toPandas().groupby("outcome"):              # a row per outcome and wave
        w = int(g["t"].max()) + 1
        mu, v = np.full(w, np.nan), np.full(w, np.nan)
        mu[g["t"]] = g["s1"] / g["n"]
        v[g["t"]] = np.maximum(g["s2"] / g["n"] - (g["s1"] / g["n"]) ** 2, 0.0)
        mean[o], var[o] = mu, v
    counts = table.groupBy("outcome").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.size("t")).alias("values")).collect()
    rows_in_all = sum(r["rows"] for r in counts)
    # a block has up to DENSE cells a value
    values = sum(r["values"] for r in counts)
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, rows_in_all // 1_000), rows_in_all // 500_000, values * DENSE // PART_CELLS)
    # few outcomes a partition, so that it meets few questions of a pass, each with many subjects
    dealt = table.repartitionByRange(parts, "outcome", F.xxhash64("subject")).coalesce(parts) if parts > 1 else table.repartition(parts)
    return Panels(dealt.sortWithinPartitions("outcome").persist(), parts, mean, var, {r["outcome"]: int(round(r["n"])) for r in counts})


# ----------------------------------------------------------------- starts

class Unit(NamedTuple):
    """A start in units of the data's spread: seed, and per class offset, slope, curve, share; scale of the random effects."""
    seed: int
    offset: tuple[float, ...]
    slope: tuple[float, ...]
    curve: tuple[float, ...]
    scale: float
    share: tuple[float, ...]


def unit_starts(classes: int, n: int, seed: int) -> list[Unit]:
    """Start 0 spreads the classes evenly over +-1 sd; each other one is drawn with a seed of its own."""
    spread = [0.0] if classes == 1 else np.linspace(-1.0, 1.0, classes).tolist()
    out = [Unit(seed, tuple(spread), (0.0,) * classes, (0.0,) * classes, 1.0, (1.0 / classes,) * classes)]
    for i in range(1, n):
        rng = np.random.default_rng(seed + i)
        draw = lambda x: tuple(round(float(v), 6) for v in x)
        share = np.round(rng.dirichlet(np.full(classes, 4.0)), 6)
        share[-1] = 1.0 - share[:-1].sum()
        out.append(Unit(seed + i, draw(np.sort(rng.uniform(-1.5, 1.5, classes))), draw(rng.normal(0, 1, classes)),
                        draw(rng.normal(0, 1, classes)), round(float(rng.uniform(0.2, 1.5)), 6), tuple(float(x) for x in share)))
    return out


def scaled_start(unit: Unit, panels: Panels, m: Model) -> dict:
    """A start's parameters on the scale of the model's outcome."""
    mu, var = panels.mean[m.outcome], panels.var[m.outcome]
    return start_at(unit, m, len(mu), float(np.nanmean(mu)), float(np.sqrt(np.nanmean(var))))


def start_at(unit: Unit, m: Model, w: int, base: float, sd: float) -> dict:
    """A start's parameters for w waves of mean ``base`` and deviation ``sd``."""
    a = np.zeros((m.classes, 3))
    a[:, 0] = base + sd * np.array(unit.offset)
    a[:, 1] = sd / w * np.array(unit.slope)
    a[:, 2] = sd / (w * w) * np.array(unit.curve)
    a[:, [f for f in range(3) if f not in m.factors]] = 0.0
    psi = np.zeros((m.classes, 3, 3))
    for f in m.random:
        psi[:, f, f] = 0.25 * sd * sd / (1.0 + 10.0 * f * f) * unit.scale
    return {"a": a, "th": np.full(w, max(0.5 * sd * sd, 1e-3)), "psi": psi, "pi": np.array(unit.share)}


# ----------------------------------------------------------------- kernels on flat values

DENSE = 4                   # cells of a block per value, at most, before subjects are split by their last wave
BLOCK_CELLS = 4_000_000
BLOCK_VALUES = 500_000      # values after which a staged block takes no more batches


@dataclass(frozen=True)
class Flat:
    """Values of n subjects one after another: row and wave of each, first value of each subject, weights."""
    r: np.ndarray
    t: np.ndarray
    y: np.ndarray
    first: np.ndarray
    weight: np.ndarray

    @functools.cached_property
    def powers(self) -> np.ndarray:
        return np.power(self.t[:, None].astype(float), np.arange(5)[None])

    @functools.cached_property
    def blocks(self) -> list[Block]:
        """The subjects as blocks of bounded size: all together, or by size of their last wave where they are very uneven."""
        width = np.maximum.reduceat(self.t, self.first) + 1
        even = len(width) * int(width.max()) <= DENSE * len(self.t)
        group = np.zeros(len(width), dtype=int) if even else np.frexp(width.astype(float))[1]
        out = []
        for g in np.unique(group):
            of = np.flatnonzero(group == g)
            step = max(1, BLOCK_CELLS // int(width[of].max()))
            out += [self._block(of[i:i + step], int(width[of[i:i + step]].max())) for i in range(0, len(of), step)]
        return out

    def _block(self, of: np.ndarray, W: int) -> Block:
        place = np.full(len(self.first), -1)
        place[of] = np.arange(len(of))
        mine = place[self.r] >= 0
        t, y = self.t[mine], self.y[mine]
        cell = place[self.r[mine]] * W + t
        add = lambda x=None: np.bincount(cell, weights=x, minlength=len(of) * W).reshape(len(of), W)
        return block_of(add(), add(y), lambda c: add((y - c[t]) ** 2), self.weight[of])


def flatten(t: Sequence, y: Sequence, weight: Sequence[float]) -> Flat:
    sizes = np.array([len(v) for v in t])
    tt = np.concatenate(list(t)).astype(np.int64)
    return Flat(np.repeat(np.arange(len(sizes)), sizes), tt, np.concatenate(list(y)).astype(float), np.cumsum(sizes) - sizes,
                np.asarray(weight, dtype=float))


def _per_subject(b: Flat, x: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, b.first, axis=0)


class EStep(NamedTuple):
    """ll (n,), log densities with shares (n, K), posteriors (n, K), and per class b (n, 3), D (n, 3, 3), g (n, 3); G (n, 3, 3)."""
    ll: np.ndarray
    post: np.ndarray
    b: list[np.ndarray]
    D: list[np.ndarray]
    g: list[np.ndarray]
    G: np.ndarray


def estep(v: Flat, p: dict) -> EStep:
    """Closed-form E step: all sums over a subject's values, then 3 x 3 algebra."""
    inv = 1.0 / p["th"][v.t]
    moments = _per_subject(v, v.powers * inv[:, None])
    G = moments[:, np.add.outer(np.arange(3), np.arange(3))]
    fixed = _per_subject(v, np.log(p["th"])[v.t] + LN2PI)
    n, K = len(v.first), len(p["pi"])
    lp, bs, Ds, gs = np.empty((n, K)), [], [], []
    for k in range(K):
        e = v.y - v.powers[:, :3] @ p["a"][k]
        ew = e * inv
        g = _per_subject(v, v.powers[:, :3] * ew[:, None])
        quad = _per_subject(v, e * ew)
        if p["psi"][k].any():
            M = np.eye(3)[None] + p["psi"][k][None] @ G
            D = np.linalg.solve(M, np.broadcast_to(p["psi"][k], (n, 3, 3)))
            b = (D @ g[:, :, None])[:, :, 0]
            lp[:, k] = -0.5 * (fixed + np.log(np.linalg.det(M)) + quad - (g * b).sum(1)) + np.log(p["pi"][k])
        else:
            D, b = np.zeros((n, 3, 3)), np.zeros((n, 3))
            lp[:, k] = -0.5 * (fixed + quad) + np.log(p["pi"][k])
        bs.append(b)
        Ds.append(D)
        gs.append(g)
    top = lp.max(1)
    ll = top + np.log(np.exp(lp - top[:, None]).sum(1))
    return EStep(ll, np.exp(lp - ll[:, None]), bs, Ds, gs, G)


def _spread(D: np.ndarray, v: Flat) -> np.ndarray:
    """z' D z of each value."""
    d = D[v.r]
    return (d[:, 0, 0] + 2 * d[:, 0, 1] * v.powers[:, 1] + (2 * d[:, 0, 2] + d[:, 1, 1]) * v.powers[:, 2]
            + 2 * d[:, 1, 2] * v.powers[:, 3] + d[:, 2, 2] * v.powers[:, 4])


def em_sums(v: Flat, p: dict) -> np.ndarray:
    """Sums for the M step and the scores, flat: per class sw, sy, syy (W each), sbb (9), sp, most likely; then ll and entropy sum."""
    return em_sums_of(v.blocks, [p])[0]


def em_sums_of(blocks: Sequence[Block], params: Sequence[dict], scores: bool = True) -> list[np.ndarray]:
    """``em_sums`` of blocks for many parameter sets of one outcome; those with as many classes and the same random effects at once."""
    alike: dict[tuple, list[int]] = {}
    for i, p in enumerate(params):
        alike.setdefault((len(p["pi"]), *p["psi"].any(axis=(0, 1))), []).append(i)
    found: list = [None] * len(params)
    for at in alike.values():
        a, th, psi, pi = (np.stack([params[i][x] for i in at]) for x in ("a", "th", "psi", "pi"))
        (G, K), W = pi.shape, th.shape[1]
        out, ll, entropy = np.zeros((G, K, 3 * W + 11)), np.zeros(G), np.zeros(G)
        for block in blocks:
            w = block.y.shape[0]
            x, x_ll, x_entropy = grid_sums(block, design(range(w)), a, th[:, :w], psi, pi, scores)
            for i in range(3):
                out[:, :, i * W:i * W + w] += x[:, :, i * w:(i + 1) * w]
            out[:, :, 3 * W:] += x[:, :, 3 * w:]
            ll, entropy = ll + x_ll, entropy + x_entropy
        for g, i in enumerate(at):
            found[i] = np.concatenate([out[g].ravel(), [ll[g], entropy[g]]])
    return found


def _unpacked(x: np.ndarray, K: int, W: int) -> dict:
    """``em_sums`` as the arrays of ``fit.mstep`` (one group), with the scores."""
    c = x[:-2].reshape(K, 3 * W + 11)
    return {"sw": c[None, :, :W], "sy": c[None, :, W:2 * W], "syy": c[None, :, 2 * W:3 * W],
            "sbb": c[None, :, 3 * W:3 * W + 9].reshape(1, K, 3, 3), "sp": c[None, :, 3 * W + 9], "likely": c[:, 3 * W + 10],
            "ll": float(x[-2]), "entropy": float(x[-1])}


# ----------------------------------------------------------------- passes

def _by_outcome(asked: Sequence[tuple[str, dict]]) -> dict[str, list[int]]:
    by: dict[str, list[int]] = {}
    for i, (o, _) in enumerate(asked):
        by.setdefault(o, []).append(i)
    return by


SUMS_SCHEMA = "at int, sums binary"      # sums as the bytes of their numbers: lists of them cost more than the sums themselves


def _sent(found: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"at": list(found), "sums": [np.asarray(x, dtype=float).tobytes() for x in found.values()]})


def _add(found: dict, at: int, x: np.ndarray) -> None:
    found[at] = found[at] + x if at in found else x


def _added(panels: Panels, table: DataFrame, run, n: int, outcomes: Sequence[str]) -> list[np.ndarray]:
    """The sums (at, sums) that ``run`` makes of a table's partitions, added for each of n questions about ``outcomes``.

    A partition sends the sums of what it has met; those of many partitions are added
    up in Spark, so the driver receives a fixed number of values per question.
    """
    wanted = table.where(F.col("outcome").isin(sorted(outcomes))) if len(outcomes) < min(len(panels.n), 100) else table
    sums = wanted.mapInPandas(run, SUMS_SCHEMA)

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at, x in zip(pdf["at"], pdf["sums"]):
                _add(found, at, np.frombuffer(x))
        yield _sent(found)

    if panels.parts > FEW_PARTS:
        sums = sums.repartition(max(1, min(panels.parts, n)), "at").mapInPandas(add, SUMS_SCHEMA)
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():
        _add(out, r["at"], np.frombuffer(r["sums"]))
    return [out.get(i, 0.0) for i in range(n)]


def grid_pass(panels: Panels, asked: Sequence[tuple[str, dict]], kernel: Callable[[Flat, dict], np.ndarray] = em_sums) -> list[np.ndarray]:
    """``kernel`` summed over all subjects for each (outcome, parameters) of ``asked``, in one pass over the panels."""
    ship_package(panels.table.sparkSession)
    by_outcome = _by_outcome(asked)
    params = [p for _, p in asked]

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            for o, part in pdf.groupby("outcome"):
                if o in by_outcome:
                    v = flatten(part["t"], part["y"], part["weight"])
                    for i in by_outcome[o]:
                        _add(found, i, kernel(v, params[i]))
        yield _sent(found)

    return _added(panels, panels.table, run, len(asked), by_outcome)


def panel_blocks(panels: Panels) -> DataFrame:
    """(outcome, block): the subjects laid out in blocks once, cached for all EM passes of a search."""
    ship_package(panels.table.sparkSession)

    def written(o, parts):
        part = pd.concat(parts)
        for v in flatten(part["t"], part["y"], part["weight"]).blocks:
            yield pd.DataFrame({"outcome": [o], "block": [written_block(v)]})

    def run(batches):
        # rows come in the order of their outcomes
        kept, values, last = [], 0, None
        for o, part in (x for pdf in batches for x in pdf.groupby("outcome")):
            if kept and (o != last or values >= BLOCK_VALUES):
                yield from written(last, kept)
                kept, values = [], 0
            kept.append(part)
            values, last = values + part["t"].map(len).sum(), o
        if kept:
            yield from written(last, kept)

    return panels.table.mapInPandas(run, "outcome string, block binary").persist()


ASK_VALUES = 200_000        # values of sums that a job asks a partition for, so that the driver takes in few at once


def em_pass(panels: Panels, blocks: DataFrame, asked: Sequence[tuple[str, dict]], scores: bool = True) -> list[np.ndarray]:
    """``em_sums`` over all subjects for each (outcome, parameters) of ``asked``, in one pass over ``panel_blocks``.

    Very many parameter sets are dealt over several jobs, each with some of every model.
    """
    values = sum(len(p["pi"]) * (3 * len(p["th"]) + 11) + 2 for _, p in asked)
    jobs = max(1, min(len(asked), -(-values // ASK_VALUES)))
    out: list = [None] * len(asked)
    for j in range(jobs):
        out[j::jobs] = _em_job(panels, blocks, asked[j::jobs], scores)
    return out


def _em_job(panels: Panels, blocks: DataFrame, asked: Sequence[tuple[str, dict]], scores: bool) -> list[np.ndarray]:
    by_outcome = _by_outcome(asked)
    params = [p for _, p in asked]

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for pdf in batches:
            for o, block in zip(pdf["outcome"], pdf["block"]):
                at = by_outcome.get(o, [])
                for i, x in zip(at, em_sums_of([read_block(block)], [params[i] for i in at], scores)):
                    _add(found, i, x)
        yield _sent(found)

    return _added(panels, blocks, run, len(asked), by_outcome)


def _moved(m: Model, p: dict, s: dict, W: int) -> dict:
    """The parameters after the M step; as they are where the likelihood is not finite."""
    return mstep(s, 0, p, design(range(W)), m.factors, m.random, m.per_class, m.shared_residual) if np.isfinite(s["ll"]) else p


def _em_map(panels: Panels, blocks: DataFrame, asked: Sequence[tuple[Model, list[dict]]], scores: bool = True
            ) -> list[tuple[list[dict], np.ndarray, list[dict]]]:
    """EM step of every parameter set of every model, in one pass: (new sets, their likelihoods, the sums) per model."""
    flat = [(m.outcome, p) for m, ps in asked for p in ps]
    sums = iter(em_pass(panels, blocks, flat, scores))
    out = []
    for m, ps in asked:
        W = panels.waves(m.outcome)
        got = [_unpacked(next(sums), m.classes, W) for _ in ps]
        new = [_moved(m, p, s, W) for p, s in zip(ps, got)]
        out.append((new, np.array([s["ll"] for s in got]), got))
    return out


def fit_grid(panels: Panels, models: Sequence[Model], n_starts: int = 100, keep: int = 20, stage1_iter: int = 10, max_iter: int = 500,
             tol: float = 1e-7, seed: int = 7) -> list[dict]:
    """Every model's multi-start fit (see ``fit.fit_em``), all in the same passes; each model and start stops by itself.

    A result has the model, n, parameters, params, ll, converged, best_replicated, the
    ranked starts (ll, seed, number), and at the best parameters the class counts on
    three bases (model, posterior, likely), the entropy, and the standard errors of the
    class curves given classes, random effects and residual variances (curve_se; see
    ``information`` for those that let everything vary).
    """
    searches, asks, done = {}, {}, {}
    units = {m: unit_starts(m.classes, n_starts, seed) for m in models}
    for m in models:
        searches[m] = starts_search([scaled_start(u, panels, m) for u in units[m]], m.classes, panels.waves(m.outcome), m.factors,
                                    m.random, keep, stage1_iter, max_iter, tol)
        asks[m] = next(searches[m])
    blocks = panel_blocks(panels)
    while asks:
        order = list(asks)
        for m, (new, ll, _) in zip(order, _em_map(panels, blocks, [(m, asks[m]) for m in order], scores=False)):
            try:
                asks[m] = searches[m].send((new, ll))
            except StopIteration as end:
                done[m] = end.value
                del asks[m]
    last = _em_map(panels, blocks, [(m, [done[m]["params"]]) for m in models])
    blocks.unpersist()
    return [_result(m, panels.n[m.outcome], panels.waves(m.outcome), done[m]["params"], got[0], done[m]["start_lls"], [units[m][i] for i in done[m]["kept"]], done[m]["kept"],
                    converged=done[m]["converged"]) for m, (_, _, got) in zip(models, last)]


def grid_steps(panels: Panels, models: Sequence[Model], steps: int, n_starts: int = 1, seed: int = 7) -> list[dict]:
    """Results of a fixed number of passes: ``steps`` - 1 EM steps of every start, then the likelihoods and scores there."""
    units = {m: unit_starts(m.classes, n_starts, seed) for m in models}
    asked = [(m, [scaled_start(u, panels, m) for u in units[m]]) for m in models]
    blocks = panel_blocks(panels)
    for _ in range(steps - 1):
        asked = [(m, new) for (m, _), (new, _, _) in zip(asked, _em_map(panels, blocks, asked, scores=False))]
    out = []
    for (m, ps), (_, ll, got) in zip(asked, _em_map(panels, blocks, asked)):
        out.append(_best_start(m, panels.n[m.outcome], panels.waves(m.outcome), ps, got, units[m]))
    blocks.unpersist()
    return out


def _best_start(m: Model, n: int, waves: int, ps: list[dict], got: list[dict], units: list[Unit]) -> dict:
    ll = np.array([s["ll"] for s in got])
    best = int(np.nanargmax(np.where(np.isfinite(ll), np.round(ll, 3), np.nan)))       # of equal ones the first start
    return _result(m, n, waves, ps[best], got[best], ll.tolist(), units, list(range(len(units))), converged=False)


def _result(m: Model, n: int, waves: int, p: dict, s: dict, lls: list[float], units: list[Unit], numbers: list[int], converged: bool) -> dict:
    ranked = sorted(((ll, u.seed, i) for ll, u, i in zip(lls, units, numbers) if np.isfinite(ll)), key=lambda x: (-round(x[0], 3), x[2]))
    Z, fi = design(range(waves)), list(m.factors)
    se = np.full((m.classes, 3), np.nan)
    for k in range(m.classes):
        info = np.einsum("t,ta,tb->ab", s["sw"][0][k] / p["th"], Z, Z)[np.ix_(fi, fi)]
        if np.linalg.matrix_rank(info) == len(fi):
            se[k, fi] = np.sqrt(np.diag(np.linalg.inv(info)))
    return {"model": m, "n": n, "curve_se": se, "waves": waves, "params": p, "ll": s["ll"],
            "parameters": count_parameters(m.classes, m.factors, m.restriction, m.shared_residual, waves),
            "converged": bool(converged), "best_replicated": sum(round(ll, 3) == round(ranked[0][0], 3) for ll, _, _ in ranked) >= 2,
            "starts": ranked, "model_counts": [float(x) * n for x in p["pi"]], "posterior_counts": s["sp"][0].tolist(),
            "likely_counts": s["likely"].tolist(),
            "entropy": float(1.0 - s["entropy"] / (n * np.log(m.classes))) if m.classes > 1 else None}


GRID_SCHEMA = ("model string, outcome string, n_classes int, restriction string, residuals string, n long, waves int, parameters int, "
               "ll double, converged boolean, best_replicated boolean, best_start int, best_seed long, entropy double, "
               "starts array<struct<ll:double,seed:long,start:int>>, "
               "classes array<struct<class:int,i:double,s:double,q:double,se_i:double,se_s:double,se_q:double,share:double,var_i:double,"
               "model_count:double,posterior_count:double,likely_count:double>>")


GRID_COLUMNS = ("model outcome n_classes restriction residuals n waves parameters ll converged best_replicated best_start best_seed entropy "
                "starts classes").split()
STARTS, CLASSES = "ll seed start".split(), "class i s q se_i se_s se_q share var_i model_count posterior_count likely_count".split()


def _grid_row(r: dict) -> tuple:
    m, p = r["model"], r["params"]
    return (m.name, m.outcome, m.classes, m.restriction, "constrained" if m.shared_residual else "unconstrained", r["n"], r["waves"],
            r["parameters"], r["ll"], r["converged"], r["best_replicated"], r["starts"][0][2] + 1, r["starts"][0][1], r["entropy"],
            [dict(zip(STARTS, (ll, seed, i + 1))) for ll, seed, i in r["starts"]],
            [dict(zip(CLASSES, (k + 1, *(float(x) for x in p["a"][k]), *(None if np.isnan(x) else float(x) for x in r["curve_se"][k]),
                                float(p["pi"][k]), float(p["psi"][k][0, 0]), r["model_counts"][k], r["posterior_counts"][k], r["likely_counts"][k])))
             for k in range(m.classes)])


def grid_table(spark, results: Sequence[dict]) -> DataFrame:
    """One row per model of the results of ``fit_grid`` or ``grid_steps``; starts are ranked, numbered from 1."""
    return spark.createDataFrame([_grid_row(r) for r in results], GRID_SCHEMA)


def _cells(specs: DataFrame) -> list:
    """Rows of a spec grid, one per cell, by title."""
    rows = specs.select("title", "n_classes", "restriction", "shared_residual").collect()
    return sorted(rows, key=lambda r: r["title"])


def _model(cell, outcome: str) -> Model:
    return Model(cell["title"] % outcome, outcome, cell["n_classes"], cell["restriction"], shared_residual=cell["shared_residual"])


def grid_models(specs: DataFrame, outcomes: Sequence[str]) -> list[Model]:
    """Models of a spec grid (J6: title, n_classes, restriction, shared_residual) for each outcome; title is a printf pattern of it."""
    cells = _cells(specs)
    return [_model(c, o) for o in sorted(outcomes) for c in cells]


# ----------------------------------------------------------------- grids over any number of outcomes

CHUNK_VALUES = 50_000       # values of an outcome that meet its parameters at once
FAN_IN = 64                 # sums of so many chunks are added at once
STATE_SCHEMA = "outcome string, n double, waves int, chunks int, sets array<array<double>>"


def _flat_set(p: dict) -> np.ndarray:
    return np.concatenate([p["a"].ravel(), p["th"], p["psi"].ravel(), p["pi"]])


def _unflat_set(x, K: int) -> dict:
    x = np.array(x, dtype=float)
    W = len(x) - 13 * K
    return {"a": x[:3 * K].reshape(K, 3), "th": x[3 * K:3 * K + W], "psi": x[3 * K + W:-K].reshape(K, 3, 3), "pi": x[-K:]}


def grid_steps_table(panel: DataFrame, specs: DataFrame, steps: int, n_starts: int = 1, seed: int = 7) -> DataFrame:
    """``grid_table`` of ``grid_steps``, for every outcome of a panel however many there are.

    An outcome's row holds the parameters of its models and starts, whose number the
    spec grid fixes.  In a pass it meets the outcome's subjects, in chunks of bounded
    size; the chunks' sums are added and the M steps taken outcome by outcome in Spark.
    The driver sees neither parameters nor sums.
    """
    spark = panel.sparkSession
    ship_package(spark)
    cells = _cells(specs)
    units = [unit_starts(c["n_classes"], n_starts, seed) for c in cells]
    classes = [c["n_classes"] for c in cells for _ in range(n_starts)]

    rows = stage(subject_rows(panel), "panels")
    value = rows.select("outcome", "weight", F.explode(F.arrays_zip("t", "y")).alias("v"))
    waves = value.groupBy("outcome", F.col("v.t").alias("t")).agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("v.y")).alias("s1"), F.sum(F.col("weight") * F.col("v.y") * F.col("v.y")).alias("s2"))
    known = lambda x: F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))
    mean = F.col("s1") / F.col("n")
    stats = waves.groupBy("outcome").agg(known(mean).alias("base"), F.sqrt(known(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))).alias("sd"),
                                         (F.max("t") + 1).alias("waves"))
    sizes = rows.groupBy("outcome").agg(F.sum("weight").alias("n"), F.ceil(F.sum(F.size("t")) / CHUNK_VALUES).cast("int").alias("chunks"))
    stats = stage(stats.join(sizes, "outcome"), "outcomes")
    total = stats.agg(F.count(F.lit(1)).alias("outcomes"), F.sum("chunks").alias("chunks"), F.max("chunks").alias("most")).first()
    # set by hand, as tables of few bytes hold much work here
    least = 3 * spark.sparkContext.defaultParallelism
    parts = lambda groups: max(1, min(groups or 0, max(least, (groups or 0) // 50)))
    of_chunks, of_outcomes = parts(total["chunks"]), parts(total["outcomes"])

    # outcomes of several chunks are at most values / CHUNK_VALUES, which the broadcast counts
    large = stats.where(F.col("chunks") > 1).select(F.col("outcome").alias("__o"), F.col("chunks").alias("__c"))
    chunk = F.pmod(F.xxhash64("subject"), F.coalesce("__c", F.lit(1))).cast("int")
    subjects = rows.join(checked_broadcast(large), F.col("outcome") == F.col("__o"), "left").select("outcome", chunk.alias("chunk"), "t", "y", "weight")
    subjects = subjects.repartition(of_chunks, "outcome", "chunk").persist()

    def starts(batches):
        for pdf in batches:
            sets = [[_flat_set(start_at(u, _model(c, r.outcome), int(r.waves), r.base, r.sd)) for c, us in zip(cells, units) for u in us]
                    for r in pdf.itertuples()]
            yield pdf[["outcome", "n", "waves", "chunks"]].assign(sets=sets)

    def sums(key, part, asked):
        if not len(part) or not len(asked):
            return pd.DataFrame({"outcome": [], "at": [], "sums": []})
        v = flatten(part["t"], part["y"], part["weight"])
        found = em_sums_of(v.blocks, [_unflat_set(x, K) for x, K in zip(asked["sets"].iloc[0], classes)])
        return pd.DataFrame({"outcome": [key[0]], "at": [key[1]], "sums": [np.concatenate(found)]})

    def added(key, part):
        return pd.DataFrame({"outcome": [key[0]], "at": [key[1]], "sums": [np.sum([np.array(x, dtype=float) for x in part["sums"]], axis=0)]})

    def cell_sets(part, state):
        """Per cell of the outcome: its model, parameter sets and their sums."""
        r = state.iloc[0]
        W, x = int(r["waves"]), np.sum([np.array(v, dtype=float) for v in part["sums"]], axis=0)
        sets = [_unflat_set(p, K) for p, K in zip(r["sets"], classes)]
        ends = np.cumsum([K * (3 * W + 11) + 2 for K in classes])[:-1]
        got = [_unpacked(v, K, W) for v, K in zip(np.split(x, ends), classes)]
        for i, c in enumerate(cells):
            at = slice(i * n_starts, (i + 1) * n_starts)
            yield _model(c, r["outcome"]), sets[at], got[at], W, int(round(r["n"])), units[i]

    def moved(part, state):
        sets = [_flat_set(_moved(m, p, s, W)) for m, ps, got, W, _, _ in cell_sets(part, state) for p, s in zip(ps, got)]
        return state[["outcome", "n", "waves", "chunks"]].assign(sets=[sets])

    def result(part, state):
        found = [_grid_row(_best_start(m, n, W, ps, got, us)) for m, ps, got, W, n, us in cell_sets(part, state)]
        return pd.DataFrame(found, columns=GRID_COLUMNS)

    def one_pass(state: DataFrame, then, schema: str) -> DataFrame:
        asked = state.select("outcome", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "sets").repartition(of_chunks, "outcome", "chunk")
        s = subjects.groupBy("outcome", "chunk").cogroup(asked.groupBy("outcome", "chunk")).applyInPandas(sums, "outcome string, at int, sums array<double>")
        many = total["most"] or 0
        while many > FAN_IN:
            s = s.groupBy("outcome", F.floor(F.col("at") / FAN_IN).cast("int").alias("at")).applyInPandas(added, "outcome string, at int, sums array<double>")
            many = -(-many // FAN_IN)
        s, state = s.repartition(of_outcomes, "outcome"), state.repartition(of_outcomes, "outcome")
        return stage(s.groupBy("outcome").cogroup(state.groupBy("outcome")).applyInPandas(then, schema), "grid-state")

    state = stage(stats.repartition(of_outcomes, "outcome").mapInPandas(starts, STATE_SCHEMA), "grid-state")
    for _ in range(steps - 1):
        state = one_pass(state, moved, STATE_SCHEMA)
    out = one_pass(state, result, GRID_SCHEMA)
    subjects.unpersist()
    return out

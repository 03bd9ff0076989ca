"""Information matrices of fitted growth models (C5, C7, C8 on M3-M8).

Every subject has a score vector: the derivatives of its log-likelihood by all free
parameters, in closed form from the E step.  One pass over the panels sums the scores'
outer products, and the total scores at parameters moved a little each way, whose
differences are the observed information.  From these come ordinary and sandwich
standard errors, the scaling factor of a robust likelihood-ratio test, and, from the
cross products of two models' scores, the reference distribution of a class-count test.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from trajectra.functions import stats as ST
from trajectra.operators.grid_fit import Flat, Model, Panels, _per_subject, _spread, estep, grid_pass

CURVE = "isq"


def _psi_slots(m: Model) -> list[tuple[tuple[int, ...], int, int]]:
    """Free random-effect (co)variances: the classes that share each, row and column."""
    pairs = [(a, b) for i, a in enumerate(m.random) for b in m.random[i:]]
    every = tuple(range(m.classes))
    if m.per_class is True:
        return [((k,), a, b) for k in every for a, b in pairs]
    if m.per_class == "i":
        return [((k,), 0, 0) for k in every] + [(every, a, b) for a, b in pairs if (a, b) != (0, 0)]
    return [(every, a, b) for a, b in pairs]


def parameter_names(m: Model, waves: int) -> list[str]:
    """Names of the free parameters in the order of ``to_free``."""
    names = [f"{CURVE[f]}_{k + 1}" for k in range(m.classes) for f in m.factors]
    for ks, a, b in _psi_slots(m):
        names.append(f"psi_{CURVE[a]}{CURVE[b]}" + (f"_{ks[0] + 1}" if len(ks) < m.classes else ""))
    names += ["theta"] if m.shared_residual else [f"theta_{t}" for t in range(waves)]
    return names + [f"logit_{k + 1}" for k in range(m.classes - 1)]


def to_free(m: Model, p: dict) -> np.ndarray:
    """The free parameters of a fit as one vector; class shares as logits against the last class."""
    psi = [p["psi"][ks[0]][a, b] for ks, a, b in _psi_slots(m)]
    th = p["th"][:1] if m.shared_residual else p["th"]
    return np.concatenate([p["a"][:, list(m.factors)].ravel(), psi, th, np.log(p["pi"][:-1] / p["pi"][-1])])


def from_free(m: Model, x: np.ndarray, waves: int) -> dict:
    K, f = m.classes, list(m.factors)
    a = np.zeros((K, 3))
    a[:, f] = x[:K * len(f)].reshape(K, len(f))
    at = K * len(f)
    psi = np.zeros((K, 3, 3))
    for ks, r, c in _psi_slots(m):
        for k in ks:
            psi[k][r, c] = psi[k][c, r] = x[at]
        at += 1
    w = 1 if m.shared_residual else waves
    th = np.full(waves, x[at]) if m.shared_residual else x[at:at + w].copy()
    e = np.exp(np.append(x[at + w:], 0.0))
    return {"a": a, "th": th, "psi": psi, "pi": e / e.sum()}


def scores(v: Flat, m: Model, p: dict) -> np.ndarray:
    """Score vector of each subject (n x free parameters)."""
    e, n, W = estep(v, p), len(v.first), len(p["th"])
    f, slots = list(m.factors), _psi_slots(m)
    means, psi = [], np.zeros((n, len(slots)))
    theta = np.zeros(n if m.shared_residual else n * W)
    th = p["th"][v.t]
    for k in range(m.classes):
        post = e.post[:, k]
        u = e.g[k] - (e.G @ e.b[k][:, :, None])[:, :, 0]            # Z' V^-1 (y - mean)
        V = e.G - e.G @ e.D[k] @ e.G                                # Z' V^-1 Z
        means.append(post[:, None] * u[:, f])
        for j, (ks, a, b) in enumerate(slots):
            if k in ks:
                psi[:, j] += post * (u[:, a] * u[:, b] - V[:, a, b]) * (0.5 if a == b else 1.0)
        rest = v.y - v.powers[:, :3] @ p["a"][k] - (v.powers[:, :3] * e.b[k][v.r]).sum(1)
        each = post[v.r] * 0.5 * ((rest / th) ** 2 - 1.0 / th + _spread(e.D[k], v) / th ** 2)
        theta += _per_subject(v, each) if m.shared_residual else np.bincount(v.r * W + v.t, weights=each, minlength=n * W)
    return np.concatenate([*means, psi, theta.reshape(n, -1), e.post[:, :-1] - p["pi"][:-1]], axis=1)


def _sums(v: Flat, asked: list[tuple[Model, dict]]) -> np.ndarray:
    """Total score of one model, or outer products of the joint scores of several, flat."""
    if len(asked) == 1 and asked[0][0] == "total":
        _, (m, p) = asked[0]
        return v.weight @ scores(v, m, p)
    s = np.concatenate([scores(v, m, p) for m, p in asked], axis=1)
    return np.concatenate([v.weight @ s, ((s * v.weight[:, None]).T @ s).ravel()])


def score_products(panels: Panels, groups: Sequence[Sequence[tuple[Model, dict]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(total score, outer products) of the joint score vectors of each group of models of one outcome, in one pass."""
    got = grid_pass(panels, [(g[0][0].outcome, list(g)) for g in groups], _sums)
    out = []
    for x in got:
        q = int((np.sqrt(1 + 4 * len(x)) - 1) / 2 + 0.5)
        out.append((x[:q], x[q:].reshape(q, q)))
    return out


def information(panels: Panels, groups: Sequence[Sequence[tuple[Model, dict]]], step: float = 1e-5) -> list[dict]:
    """Observed information of every model and outer products of every group, in one pass.

    A result has B (outer products of the group's joint scores), H (the models'
    observed informations), and x (their free parameters).
    """
    asked: list = [(g[0][0].outcome, list(g)) for g in groups]
    places = []
    for g in groups:
        for m, p in g:
            x = to_free(m, p)
            h = step * np.maximum(1.0, np.abs(x))
            first = len(asked)
            for j in range(len(x)):
                for sign in (1.0, -1.0):
                    moved = x.copy()
                    moved[j] += sign * h[j]
                    asked.append((m.outcome, [("total", (m, from_free(m, moved, panels.waves(m.outcome))))]))
            places.append((first, x, h))
    got = grid_pass(panels, asked, _sums)
    out, at = [], iter(places)
    for i, g in enumerate(groups):
        q = int((np.sqrt(1 + 4 * len(got[i])) - 1) / 2 + 0.5)
        H, xs = [], []
        for _ in g:
            first, x, h = next(at)
            d = np.array([(got[first + 2 * j] - got[first + 2 * j + 1]) / (2 * h[j]) for j in range(len(x))])
            H.append(-(d + d.T) / 2)
            xs.append(x)
        out.append({"score": got[i][:q], "B": got[i][q:].reshape(q, q), "H": H, "x": xs})
    return out


def errors(B: np.ndarray, H: np.ndarray) -> dict:
    """Ordinary and sandwich standard errors and the scaling factor; None where the information is not positive definite."""
    try:
        np.linalg.cholesky(H)
    except np.linalg.LinAlgError:
        return {"se": None, "se_robust": None, "scaling": None}
    inv = np.linalg.inv(H)
    return {"se": np.sqrt(np.diag(inv)), "se_robust": np.sqrt(np.maximum(np.diag(inv @ B @ inv), 0.0)),
            "scaling": float(np.trace(B @ inv) / len(H))}


ERROR_SCHEMA = ("model string, outcome string, n long, ll double, parameters int, scaling double, parameter string, est double, se double, "
                "se_robust double")


def error_table(spark, panels: Panels, fits: Sequence[dict]) -> DataFrame:
    """Every free parameter of every fit (results of ``fit_grid``) with its errors, robust z and p (C7), and the model's scaling factor."""
    found = information(panels, [[(f["model"], f["params"])] for f in fits])
    rows = []
    for f, got in zip(fits, found):
        m, e = f["model"], errors(got["B"], got["H"][0])
        for j, (name, x) in enumerate(zip(parameter_names(m, f["waves"]), got["x"][0])):
            value = lambda key: None if e[key] is None else float(e[key][j])
            rows.append((m.name, m.outcome, f["n"], f["ll"], f["parameters"], e["scaling"], name, float(x), value("se"), value("se_robust")))
    z, p = ST.wald("est", "se_robust")
    return spark.createDataFrame(rows, ERROR_SCHEMA).withColumns({"z": z, "p_value": p})


# ----------------------------------------------------------------- C8: class-count test

def weighted_chi2_upper(x: float, weights: np.ndarray, points: int = 200_001) -> float:
    """P(sum of w_i chi-square(1) > x) by numerical inversion of the characteristic function (Imhof, 1961)."""
    w = np.asarray(weights, dtype=float)
    w = w[np.abs(w) > 1e-9 * max(np.abs(w).max(initial=0.0), 1e-300)]
    if not len(w):
        return float(x < 0)
    w, x = w / np.abs(w).max(), x / np.abs(w).max()
    # u = s / (1 - s) spread over the half line; the integrand falls with u^(-1 - len(w) / 2)
    s = (np.arange(points) + 0.5) / points
    u = s / (1 - s)
    angle = 0.5 * (np.arctan(np.outer(u, w)).sum(1) - x * u)
    size = np.exp(0.25 * np.log1p(np.outer(u * u, w * w)).sum(1))
    value = 0.5 + (np.sin(angle) / (u * size) / (1 - s) ** 2).mean() / np.pi
    return float(min(1.0, max(0.0, value)))


def reference_distribution(got: dict) -> np.ndarray:
    """Weights of the chi-squares that 2 (LL - LL of the smaller model) follows (Vuong, 1989), from ``information`` of [larger, smaller]."""
    q = len(got["x"][0])
    B, F_inv, G_inv = got["B"], np.linalg.pinv(got["H"][0]), np.linalg.pinv(got["H"][1])
    W = np.block([[B[:q, :q] @ F_inv, B[:q, q:] @ G_inv], [-B[q:, :q] @ F_inv, -B[q:, q:] @ G_inv]])
    return np.sort(np.linalg.eigvals(W).real)[::-1]


COUNT_TEST_SCHEMA = ("model string, outcome string, n long, n_classes int, ll_one_less double, lrt double, dp int, mean double, sd double, "
                     "p_value double, lrt_adjusted double, p_adjusted double")


def class_count_tests(spark, panels: Panels, fits: Sequence[dict]) -> DataFrame:
    """Each fit against the one with one class less of its outcome, restriction and residual rule.

    lrt: twice the difference of log-likelihoods; mean, sd and p_value: of its reference
    distribution; lrt_adjusted: lrt / (1 + 1 / (dp ln n)), with its p.
    """
    key = lambda m: (m.outcome, m.restriction, m.shared_residual, m.factors)
    by = {(key(f["model"]), f["model"].classes): f for f in fits}
    pairs = [(f, by[key(f["model"]), f["model"].classes - 1]) for f in fits if (key(f["model"]), f["model"].classes - 1) in by]
    found = information(panels, [[(f["model"], f["params"]), (g["model"], g["params"])] for f, g in pairs]) if pairs else []
    rows = []
    for (f, g), got in zip(pairs, found):
        weights = reference_distribution(got)
        lrt, dp = 2.0 * (f["ll"] - g["ll"]), f["parameters"] - g["parameters"]
        adjusted = lrt / (1.0 + 1.0 / (dp * np.log(f["n"])))
        rows.append((f["model"].name, f["model"].outcome, f["n"], f["model"].classes, g["ll"], float(lrt), int(dp), float(weights.sum()),
                     float(np.sqrt(2.0 * (weights ** 2).sum())), weighted_chi2_upper(lrt, weights), float(adjusted),
                     weighted_chi2_upper(adjusted, weights)))
    return spark.createDataFrame(rows, COUNT_TEST_SCHEMA)

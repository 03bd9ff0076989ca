"""Fitting growth models as distributed aggregations (M1-M4, M6-M8).

* M1 ``subject_slopes``: per-subject least squares with Spark's regression aggregates.
* M2 ``ols`` / ``polynomial_fits``: normal equations from one aggregate of cross
  products; the 3x3 solve is a column expression.
* M3/M4 ``growth_curve``: per-pattern sufficient statistics (A14), then EM on the
  driver over a bounded number of patterns; beyond it the distributed passes.
* M6-M8 ``class_growth`` / ``growth_mixture`` / ``multi_start``: EM where every
  step is one narrow pass over the cached wide panel (closed-form E step for all
  classes and starts in the same row) and one partial aggregate whose size is
  starts x classes x waves; only that small table reaches the driver.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable
from typing import NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.operators.joins import checked_broadcast
from trajectra.session import stage

LN2PI = math.log(2.0 * math.pi)


# ----------------------------------------------------------------- M1

def subject_slopes(panel: DataFrame, subject: str = "subject", time: str = "wave", y: str = "y") -> DataFrame:
    """M1: per-subject least-squares line of y on time (partial aggregation per subject)."""
    p = panel.where(F.col(y).isNotNull())
    return p.groupBy(subject).agg(
        F.regr_count(F.col(y), F.col(time).cast("double")).alias("n"),
        F.regr_intercept(F.col(y), F.col(time).cast("double")).alias("intercept"),
        F.regr_slope(F.col(y), F.col(time).cast("double")).alias("slope"))


# ----------------------------------------------------------------- M2

def _centred_sums(names: Sequence[str], y: str) -> list:
    """n, and a struct of means (m_i) and centred cross products (s_i_j), with Spark's merging moments."""
    cols = [*names, y]
    cells = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    cells += [(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"s_{i}_{j}")
              for i, a in enumerate(cols) for j, b in enumerate(cols[:i + 1])]
    return [F.count(F.lit(1)).alias("n"), F.struct(*cells).alias("__s0")]


def _cell(i: int, j: int) -> str:
    return f"s_{max(i, j)}_{min(i, j)}"


def _sweep(df: DataFrame, k: int, size: int) -> DataFrame:
    """One step of the sweep operator on the symmetric matrix in struct ``__s<k>``, pivot k, into ``__s<k+1>``.

    After sweeping the regressors, the last row holds their coefficients and the
    residual sum of squares, and the block of the regressors minus its inverse.
    """
    v = lambda i, j: f"__s{k}.{_cell(i, j)}"
    d = f"nullif({v(k, k)}, 0.0D)"
    new = [f"'m_{i}', __s{k}.m_{i}" for i in range(size)]
    for i in range(size):
        for j in range(i + 1):
            if i == k and j == k:
                e = f"-1.0D / {d}"
            elif k in (i, j):
                e = f"{v(i, j)} / {d}"
            else:
                e = f"{v(i, j)} - {v(i, k)} * {v(k, j)} / {d}"
            new.append(f"'{_cell(i, j)}', {e}")
    return df.selectExpr("*", f"named_struct({', '.join(new)}) AS __s{k + 1}")


def _fit_columns(p: int, y: int) -> dict[str, str]:
    """beta, se and rss from sums swept over the first ``p`` regressors (row ``y`` is the outcome)."""
    v = lambda i, j: f"__s{p}.{_cell(i, j)}"
    m = lambda i: f"__s{p}.m_{i}"
    rss = f"greatest({v(y, y)}, 0.0D)"
    s2 = f"({rss} / nullif(n - {p + 1}, 0))"
    out = {"rss": rss, "beta_0": " - ".join([m(y), *[f"{v(y, j)} * {m(j)}" for j in range(p)]])}
    out.update({f"beta_{j + 1}": v(y, j) for j in range(p)})
    spread = " + ".join(["1.0D / n", *[f"(-{v(i, j)}) * {m(i)} * {m(j)}" for i in range(p) for j in range(p)]])
    out["se_0"] = f"sqrt({s2} * ({spread}))"
    out.update({f"se_{j + 1}": f"sqrt({s2} * (-{v(j, j)}))" for j in range(p)})
    return out


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """M2: least squares of y on an intercept and any number of regressors, per group.

    One aggregate of centred cross products (partial, map-side; digits are kept on
    large means), then one projection per regressor.  Returns n, beta_0.., se_..,
    t_.., rss, sigma2 (ML); coefficients of collinear regressors are NULL.  Rows with
    a NULL in y or a regressor are left out.
    """
    p = len(xs)
    names = [f"__x_{i}" for i in range(p)]
    data = df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip(xs, names)],
                     F.col(y).cast("double").alias("__y")).na.drop(subset=[*names, "__y"])
    s = data.groupBy(*keys).agg(*_centred_sums(names, "__y"))
    for k in range(p):
        s = _sweep(s, k, p + 1)
    s = s.selectExpr(*keys, "n", *[f"{e} AS {c}" for c, e in _fit_columns(p, p).items()])
    return s.selectExpr("*", "rss / nullif(n, 0) AS sigma2", *[f"beta_{j} / nullif(se_{j}, 0.0D) AS t_{j}" for j in range(p + 1)])


def polynomial_fits(panel: DataFrame, keys: Sequence[str], degrees: Sequence[int] = (0, 1, 2),
                    time: str = "wave", y: str = "y") -> DataFrame:
    """Maximum-likelihood polynomial growth curves of y on time per group and degree.

    One aggregate of centred products of the powers of time per group; sweeping
    one more power gives the next degree.  ll = -n/2 (ln 2 pi + ln sigma2 + 1),
    parameters = degree + 2 (coefficients and the residual variance).
    """
    top = max(degrees)
    t = F.col(time).cast("double")
    names = [f"__x_{k}" for k in range(top)]
    data = panel.where(F.col(y).isNotNull()).select(
        *keys, *[F.pow(t, F.lit(k + 1)).alias(n) for k, n in enumerate(names)], F.col(y).cast("double").alias("__y"))
    s = data.groupBy(*keys).agg(*_centred_sums(names, "__y"))
    for k in range(top):
        s = _sweep(s, k, top + 1)
    terms = range(max(top, 2) + 1)
    fits = []
    for degree in degrees:
        cols = _fit_columns(degree, top)
        fits.append("named_struct(" + ", ".join(
            [f"'degree', {degree}", *[f"'beta_{a}', {cols.get(f'beta_{a}', '0.0D')}" for a in terms],
             f"'sigma2', {cols['rss']} / n", *[f"'se_{a}', {cols.get(f'se_{a}', 'CAST(NULL AS DOUBLE)')}" for a in terms]]) + ")")
    s = s.selectExpr(*keys, "n", f"explode(array({', '.join(fits)})) AS f").select(*keys, "n", "f.*")
    return s.selectExpr(*keys, "degree", "n", *[f"beta_{a}" for a in terms], "sigma2", *[f"se_{a}" for a in terms],
                        f"-0.5D * n * ({LN2PI!r}D + ln(sigma2) + 1.0D) AS ll", "CAST(degree + 2 AS INT) AS parameters")


def with_scaling(fits: DataFrame, panel: DataFrame, keys: Sequence[str], time: str = "wave",
                 y: str = "y") -> DataFrame:
    """Robust (sandwich) scaling factor of each fit's log-likelihood.

    For a normal polynomial fit the mean coefficients keep a factor of 1 and the
    residual variance gets (m4 / sigma^4 - 1) / 2 (m4 = mean fourth power of the
    residuals); the model factor is their average over the parameters.  The fits of
    a group meet its rows as one array (broadcast after a count), so no row is
    multiplied or exchanged by group for the one extra pass.
    """
    fits = stage(fits, "fits")
    betas = [c for c in fits.columns if c.startswith("beta_")]
    sets = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("degree", *betas))).alias("__f"))   # a row per degree
    t = F.col(time).cast("double")
    rows = panel.where(F.col(y).isNotNull()).select(*keys, t.alias("__t"), F.col(y).alias("__y"))
    rows = rows.join(checked_broadcast(sets.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__f")),
                     [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])

    def curve(i: int):
        out = F.lit(0.0)
        for a in range(len(betas) - 1, -1, -1):
            out = out * F.col("__t") + F.col("__f")[i][f"beta_{a}"]
        return out
    degrees = sorted(r["degree"] for r in fits.select("degree").distinct().collect())       # a few numbers
    m = rows.groupBy(*keys).agg(*[F.avg(F.pow(F.col("__y") - curve(i), 4)).alias(f"__m4_{i}") for i in range(len(degrees))])
    m = m.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.explode(F.array(*[
        F.struct(F.lit(d).alias("__d"), F.col(f"__m4_{i}").alias("m4")) for i, d in enumerate(degrees)])).alias("__m"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("degree") == F.col("__m.__d")]
    out = fits.join(m, on, "left")
    return out.withColumn(
        "scaling", ((F.col("parameters") - 1) + (F.col("__m.m4") / (F.col("sigma2") * F.col("sigma2")) - 1) / 2.0)
        / F.col("parameters")).drop("__m", *[f"__k_{k}" for k in keys])


# ================================================================= EM machinery
#
# Parameters of one model (a "group": a model or one start of it) are kept on
# the driver as numpy arrays: a (K, 3) class means on z_t = (1, t, t^2),
# th (W,) residual variances (equal over classes), psi (K, 3, 3) random-effect
# covariances, pi (K,) class shares.  They are a few hundred numbers whatever the
# data size.

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

# Random-effect structure by restriction (which factors vary, and whether the
# covariance is per class).  None = one-class growth curve with all factors free.
RESTRICTION_SPEC = {
    "iq@0": ((), False),          # no random effect
    "sq@0": ((0,), False),        # random intercept, shared over classes
    " q@0": ((0, 1), False),      # random intercept and slope, shared
    "c. i": ((0, 1), "i"),        # intercept variance per class, slope variance and covariance shared
    "c.is": ((0, 1), True),       # intercept and slope (co)variances per class
}


def design(times: Sequence[float]) -> np.ndarray:
    t = np.asarray(times, dtype=float)
    return np.stack([np.ones_like(t), t, t * t], axis=1)


def patterns_of(Y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct missing patterns of a batch (P, W, bool) and each row's pattern."""
    distinct, inv = distinct_rows(~np.isnan(Y))
    return distinct.astype(bool), inv


def distinct_rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of small whole numbers, and each row's place among them; rows of up to 64 bits are compared as one number."""
    if counts.size and counts.max() > 1:
        distinct, inv = np.unique(counts, axis=0, return_inverse=True)
        return distinct, inv.ravel()
    bits = np.packbits(counts.astype(bool), axis=1)
    if bits.shape[1] > 8:
        distinct, inv = np.unique(bits, axis=0, return_inverse=True)
    else:
        wide = np.zeros((len(bits), 8), dtype=np.uint8)
        wide[:, :bits.shape[1]] = bits
        found, inv = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        distinct = found[:, None].view(np.uint8)[:, :bits.shape[1]]
    return np.unpackbits(distinct, axis=1, count=counts.shape[1]), inv.ravel()


class Block(NamedTuple):
    """Subjects with waves in rows: sums of their values about ``centre`` and of the squares (W, n; 0 where missing), the
    distinct rows of their numbers of values (P, W), each subject's pattern, the first subject of each, weights.
    Subjects are in the order of their patterns."""
    y: np.ndarray
    yy: np.ndarray
    O: np.ndarray
    at: np.ndarray
    first: np.ndarray
    centre: np.ndarray
    weight: np.ndarray


def block_of(counts: np.ndarray, sums: np.ndarray, squares: Callable[[np.ndarray], np.ndarray], weight: np.ndarray) -> Block:
    """A block of n subjects by W waves: numbers of values, their sums, and the sums of squares about given centres."""
    seen = counts.sum(0)
    centre = sums.sum(0) / np.maximum(seen, 1)
    O, at = distinct_rows(counts)
    order = np.argsort(at, kind="stable")
    at = at[order]
    y = (sums - counts * centre)[order].T
    return Block(np.ascontiguousarray(y), np.ascontiguousarray(squares(centre)[order].T), O.astype(float), at,
                 np.searchsorted(at, np.arange(len(O))), centre, weight[order])


def wide_block(Y: np.ndarray) -> Block:
    """A block of subjects (n, W) with NaN for missing."""
    seen = ~np.isnan(Y)
    return block_of(seen.astype(np.int8), np.where(seen, Y, 0.0), lambda c: np.where(seen, Y - c, 0.0) ** 2, np.ones(len(Y)))


def block_sums(v: Block, Z: np.ndarray, a: np.ndarray, th: np.ndarray, psi: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float, float]:
    """E step and M-step sums of a block for one group, as matrix products over subjects.

    Residuals are linear in the values, so squares about the class curves come from the
    values' own sums, and all that depends on the missing pattern is summed by pattern.
    Returns per class sw, sy, syy (W each; see ``msums_batch``), sbb (9), sp and the
    weight of subjects most likely in it (K, 3W + 11); the log-likelihood; and the entropy sum.
    """
    K, W, P = len(pi), len(th), len(v.O)
    by_pattern = lambda x: np.add.reduceat(x, v.first, axis=-1)
    inv = 1.0 / th
    m = a @ Z.T - v.centre
    mi = m * inv
    const = (v.O.sum(1) * LN2PI + v.O @ np.log(th))[None] + (mi * m) @ v.O.T
    free = np.flatnonzero(psi.any(axis=(0, 1)) | psi.any(axis=(0, 2)))
    r, bs, Ds = len(free), [], []
    Zr = Z[:, free]
    linear = np.concatenate([-2.0 * mi, (Zr * inv[:, None]).T]) @ v.y
    quad, U = linear[:K], linear[K:]
    quad += inv @ v.yy
    ZZ = (Zr[:, :, None] * Zr[:, None, :]).reshape(W, r * r)
    if r:
        G = ((v.O * inv) @ ZZ).reshape(P, r, r)
        for k in range(K):
            if k and (psi[k] == psi[k - 1]).all():
                D, logdet, Dv = Ds[-1], logdet, Dv
            else:
                own = psi[k][np.ix_(free, free)]
                M = np.eye(r)[None] + own[None] @ G
                D = np.linalg.solve(M, np.broadcast_to(own, (P, r, r)))
                logdet = np.log(np.linalg.det(M))
                Dv = D.reshape(P, r * r).T[:, v.at]
            g = U - (v.O @ (Zr * mi[k][:, None])).T[:, v.at]
            b = np.einsum("ijn,jn->in", Dv.reshape(r, r, -1), g)
            const[k] += logdet
            quad[k] -= np.einsum("in,in->n", g, b)
            bs.append(b)
            Ds.append(D)
    lp = -0.5 * (quad + const[:, v.at]) + np.log(pi)[:, None]
    top = lp.max(0)
    lp -= top
    post = np.exp(lp)
    total = post.sum(0)
    post /= total
    log_total = np.log(total)
    # ln post = lp - ln total; where post is 0 (below -800) the term is 0
    entropy = v.weight @ log_total - np.einsum("kn,kn->n", post, np.maximum(lp, -800.0)) @ v.weight
    w = post * v.weight
    mass = by_pattern(w)
    pbs = [w[k] * bs[k] for k in range(K if r else 0)]
    sums = np.concatenate([w, *pbs]) @ v.y.T
    sw, sy, syy = mass @ v.O, sums[:K], w @ v.yy.T
    out = np.zeros((K, 3 * W + 11))
    for k, pb in enumerate(pbs):
        sy[k] -= ((Zr @ by_pattern(pb)) * v.O.T).sum(1)
        half = {(i, j): by_pattern(pb[i] * bs[k][j]) for i in range(r) for j in range(i, r)}
        C = np.stack([half[min(i, j), max(i, j)] for i in range(r) for j in range(r)]) + mass[k] * Ds[k].reshape(P, r * r).T
        syy[k] += ((ZZ @ C) * v.O.T).sum(1) - 2.0 * (Zr.T * sums[K + k * r:K + (k + 1) * r]).sum(0)
        sbb = np.zeros((3, 3))
        sbb[np.ix_(free, free)] = C.sum(1).reshape(r, r)
        out[k, 3 * W:3 * W + 9] = sbb.ravel()
    out[:, :W], out[:, W:2 * W] = sw, sy + v.centre * sw
    out[:, 2 * W:3 * W] = syy + 2.0 * v.centre * sy + v.centre ** 2 * sw
    out[:, 3 * W + 9] = w.sum(1)
    out[:, 3 * W + 10] = np.bincount(post.argmax(0), weights=v.weight, minlength=K)
    return out, float(v.weight @ (top + log_total)), float(entropy)


PATTERN_WORK = 1_500        # subjects of a pattern times groups that are worth products of their own
TILE = 16_384               # groups x classes x subjects of a product


def grid_sums(v: Block, Z: np.ndarray, a: np.ndarray, th: np.ndarray, psi: np.ndarray, pi: np.ndarray, scores: bool = True
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``block_sums`` of many groups: a (G, K, 3), th (G, W), psi (G, K, 3, 3), pi (G, K); sums (G, K, 3W + 11), ll and entropy (G,).

    Subjects of a missing pattern share all matrices, so their E step is one product of their observed
    values with those of every group and class, and the M-step sums are another; rarer patterns go group by group.
    Without ``scores`` the entropy and the most likely classes may stay 0, which EM steps do not need.
    """
    G, K, W = *pi.shape, th.shape[1]
    out, ll, entropy = np.zeros((G, K, 3 * W + 11)), np.zeros(G), np.zeros(G)
    ends = np.append(v.first[1:], len(v.at))
    often = G * (ends - v.first) >= PATTERN_WORK
    if (~often).sum() <= G // 2:                                   # cheaper one by one than a block for each group
        often[:] = True
    free = np.flatnonzero(psi.any(axis=(0, 1, 2)) | psi.any(axis=(0, 1, 3)))
    for j in np.flatnonzero(often):
        _add_pattern(v, j, slice(v.first[j], ends[j]), Z, a, th, psi, pi, free, scores, out, ll, entropy)
    if not often.all():
        rest = _rare(v, often) if often.any() else v
        for g in range(G):
            sums, x_ll, x_entropy = block_sums(rest, Z, a[g], th[g], psi[g], pi[g])
            out[g] += sums
            ll[g] += x_ll
            entropy[g] += x_entropy
    return out, ll, entropy


def _rare(v: Block, often: np.ndarray) -> Block:
    """The subjects of the other patterns as a block of their own."""
    mine, place = ~often[v.at], np.cumsum(~often) - 1
    at = place[v.at[mine]]
    return Block(np.ascontiguousarray(v.y[:, mine]), np.ascontiguousarray(v.yy[:, mine]), v.O[~often], at,
                 np.searchsorted(at, np.arange(int((~often).sum()))), v.centre, v.weight[mine])


def _posteriors(lp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of log densities (G, K, n), each subject's highest density, and the sum of its densities over that one (1 to K)."""
    top = lp.max(1)
    if lp.shape[1] == 2:                                           # the higher one's ratio is 1: one exponential a subject
        low = np.exp(lp.min(1) - top)
        total = 1.0 + low
        low /= total
        high = 1.0 / total
        first, post = lp[:, 0] >= lp[:, 1], np.empty_like(lp)
        post[:, 0], post[:, 1] = np.where(first, high, low), np.where(first, low, high)
        return post, top, total
    post = np.exp(lp - top[:, None])
    total = post.sum(1)
    post /= total[:, None]
    return post, top, total


def _sum_of_logs(x: np.ndarray) -> np.ndarray:
    """Sums of the logarithms of numbers from 1 to 16 over the last axis, a logarithm per 250 factors."""
    return np.log(np.multiply.reduceat(x, np.arange(0, x.shape[-1], 250), axis=-1)).sum(-1)


def _add_pattern(v: Block, j: int, of: slice, Z: np.ndarray, a: np.ndarray, th: np.ndarray, psi: np.ndarray, pi: np.ndarray, free: np.ndarray,
                 scores: bool, out: np.ndarray, ll: np.ndarray, entropy: np.ndarray) -> None:
    """Adds the sums of one pattern's subjects to ``out``, ``ll`` and ``entropy`` (see ``grid_sums``).

    With U = Z' / theta and D the effects' covariance given y, an effect's mean is D U y less D g0, where g0 is U of the
    class curve.  What is equal for all classes leaves the posteriors alone and enters the likelihood by the sums of products of values.
    """
    seen = np.flatnonzero(v.O[j])
    c, w, r, (G, K), W = v.O[j][seen], len(seen), len(free), pi.shape, th.shape[1]
    y, yy, weight = v.y[seen, of], v.yy[seen, of], v.weight[of]
    n, plain = y.shape[1], bool((weight == 1.0).all())
    one = np.concatenate([y, np.ones((1, n))])
    values = np.concatenate([one, yy])
    Zw, Zr = Z[seen], Z[np.ix_(seen, free)]
    inv, centre = 1.0 / th[:, seen], v.centre[seen]
    m = a @ Zw.T - centre
    mi = m * inv[:, None]
    # log densities as coefficients of (y, 1)
    const = (np.log(th[:, seen]) @ c + c.sum() * LN2PI)[:, None] + (mi * m) @ c
    linear = mi
    ll -= 0.5 * (inv @ (yy @ weight))
    shared = True
    if r:
        own = psi[..., free[:, None], free[None]]
        shared = bool((own == own[:, :1]).all())
        own = own[:, :1] if shared else own
        M = np.eye(r) + own @ np.einsum("gt,ti,tj->gij", inv * c, Zr, Zr)[:, None]
        D = np.linalg.solve(M, own)
        U = Zr.T * inv[:, None]
        g0 = np.einsum("grt,t,gkt->gkr", U, c, m)
        b0 = (D @ g0[..., None])[..., 0]
        const = const + np.log(np.linalg.det(M)) - (g0 * b0).sum(-1)
        linear = mi - b0 @ U
        if shared:
            ll += 0.5 * np.einsum("gij,gji->g", D[:, 0], U @ (y * weight) @ y.T @ np.swapaxes(U, 1, 2))
    density = np.concatenate([linear, (np.log(pi) - 0.5 * const)[..., None]], axis=-1)
    sums, mixed = np.zeros((G, K, 2 * w + 1)), np.zeros((G, K, r, w + 1))
    cols = min(n, 2_048)
    rows = max(1, TILE // (K * cols))
    for at in range(0, G, rows):
        g = slice(at, min(at + rows, G))
        size = g.stop - at
        for lo in range(0, n, cols):
            x, wt = one[:, lo:lo + cols], weight[lo:lo + cols]
            lp = (density[g].reshape(-1, w + 1) @ x).reshape(size, K, -1)
            if r:
                u = (U[g].reshape(-1, w) @ x[:w]).reshape(size, 1, r, -1)
                h = D[g] @ u if r > 1 else D[g] * u                # (groups, 1 or K, r, n)
                if not shared:
                    lp += 0.5 * (u * h).sum(2)
            post, top, total = _posteriors(lp)
            if plain and not scores and K <= 16:
                ll[g] += top.sum(1) + _sum_of_logs(total)
            else:
                log_total = np.log(total)
                ll[g] += (top + log_total) @ wt
            if scores:
                # ln post = lp - top - ln total; where post is 0 (below -800) the term is 0
                entropy[g] += log_total @ wt - np.einsum("gkn,gkn,n->g", post, np.maximum(lp - top[:, None], -800.0), wt)
                likely = post.argmax(1)
                for k in range(K):
                    out[g, k, 3 * W + 10] += (likely == k) @ wt
            if not plain:
                post *= wt
            sums[g] += (post.reshape(size * K, -1) @ values[:, lo:lo + cols].T).reshape(size, K, -1)
            if r:
                ph = post[:, :, None] * h
                mixed[g] += (ph.reshape(size * K * r, -1) @ x.T).reshape(size, K, r, -1)
    mass = sums[..., w]
    sy, syy = sums[..., :w], sums[..., w + 1:]
    if r:
        # an effect is linear in y, so the sums of their products come from those of effects and values
        half = mixed[..., :w] @ np.swapaxes(D @ U[:, None], -1, -2)
        half = 0.5 * (half + np.swapaxes(half, -1, -2))
        cross = b0[..., :, None] * mixed[..., None, :, w]
        C = half - cross - np.swapaxes(cross, -1, -2) + mass[..., None, None] * (b0[..., :, None] * b0[..., None, :] + D)
        mixed = mixed - b0[..., None] * sums[..., None, :w + 1]
        sy = sy - c * (mixed[..., w] @ Zr.T)
        syy = syy + c * np.einsum("ti,gkij,tj->gkt", Zr, C, Zr) - 2.0 * np.einsum("ti,gkit->gkt", Zr, mixed[..., :w])
        out[..., (3 * W + 3 * free[:, None] + free[None]).ravel()] += C.reshape(G, K, r * r)
    sw = mass[..., None] * c
    out[..., seen] += sw
    out[..., W + seen] += sy + centre * sw
    out[..., 2 * W + seen] += syy + 2.0 * centre * sy + centre ** 2 * sw
    out[..., 3 * W + 9] += mass


def estep_batch(Y: np.ndarray, Z: np.ndarray, a: np.ndarray, th: np.ndarray, psi: np.ndarray,
                lnpi: np.ndarray, patterns: tuple | None = None):
    """Closed-form E step for a batch of subjects and one group.

    Y (n, W) with NaN for missing; a (K, 3); th (K, W); psi (K, 3, 3); lnpi (K,).
    Returns ll (n,), post (n, K), b (n, K, 3), D (P, K, 3, 3).  Determinants and
    random-effect covariances depend only on (class, missing pattern): they are solved
    once per pattern, not per subject.
    """
    Op, inv = patterns if patterns is not None else patterns_of(Y)
    O = Op[inv]
    Yz = np.where(O, Y, 0.0)
    n, W = Y.shape
    K = a.shape[0]
    P = len(Op)
    logf = np.empty((n, K))
    b = np.empty((n, K, 3))
    D = np.empty((P, K, 3, 3))
    nobs = Op.sum(1)
    ZZ = (Z[:, :, None] * Z[:, None, :]).reshape(W, 9)     # z_t z_t' flattened
    for k in range(K):
        G = ((Op / th[k]) @ ZZ).reshape(P, 3, 3)
        M = np.eye(3)[None] + np.matmul(psi[k][None], G)
        D[:, k] = np.linalg.solve(M, np.broadcast_to(psi[k], (P, 3, 3)))
        fixed = nobs * LN2PI + Op @ np.log(th[k]) + np.log(np.linalg.det(M))
        e = (Yz - Z @ a[k]) * O
        ew = e / th[k]
        g = ew @ Z
        bk = np.matmul(D[:, k][inv], g[:, :, None])[:, :, 0]
        logf[:, k] = -0.5 * (fixed[inv] + (e * ew).sum(1) - (g * bk).sum(1))
        b[:, k] = bk
    lp = logf + lnpi[None]
    mx = lp.max(1)
    ll = mx + np.log(np.exp(lp - mx[:, None]).sum(1))
    post = np.exp(lp - ll[:, None])
    return ll, post, b, D


def msums_batch(Y: np.ndarray, Z: np.ndarray, post: np.ndarray, b: np.ndarray, D: np.ndarray,
                patterns: tuple | None = None) -> dict:
    """M-step sums of a batch for one group: per class k and wave t
    sw = sum p [obs], sy = sum p (y - z'b) [obs], syy = sum p ((y - z'b)^2 + z'Dz) [obs];
    per class sp = sum p, sbb = sum p (b b' + D)."""
    Op, inv = patterns if patterns is not None else patterns_of(Y)
    O = Op[inv]
    Yz = np.where(O, Y, 0.0)
    K = post.shape[1]
    W = Y.shape[1]
    sw = np.empty((K, W)); sy = np.empty((K, W)); syy = np.empty((K, W))
    sbb = np.empty((K, 3, 3)); sp = post.sum(0)
    ZZ = (Z[:, :, None] * Z[:, None, :]).reshape(W, 9)
    for k in range(K):
        p = post[:, k]
        mass = np.bincount(inv, weights=p, minlength=len(Op))         # posterior mass by pattern
        r = (Yz - b[:, k] @ Z.T) * O
        Dk = D[:, k].reshape(len(Op), 9)
        sw[k] = mass @ Op
        sy[k] = p @ r
        syy[k] = p @ (r * r) + mass @ ((Dk @ ZZ.T) * Op)
        sbb[k] = (b[:, k] * p[:, None]).T @ b[:, k] + (mass @ Dk).reshape(3, 3)
    return {"sw": sw, "sy": sy, "syy": syy, "sbb": sbb, "sp": sp}


def _pack(params: list[dict]) -> dict:
    return {"a": np.stack([p["a"] for p in params]), "th": np.stack([p["th"] for p in params]),
            "psi": np.stack([p["psi"] for p in params]), "pi": np.stack([p["pi"] for p in params])}


def _slots(W: int) -> dict[str, slice]:
    """Layout of one (group, class) statistics vector: sw, sy, syy (W each), sbb (9), sp, ll."""
    return {"sw": slice(0, W), "sy": slice(W, 2 * W), "syy": slice(2 * W, 3 * W),
            "sbb": slice(3 * W, 3 * W + 9), "sp": slice(3 * W + 9, 3 * W + 10), "ll": slice(3 * W + 10, 3 * W + 11)}


BLOCK_CELLS = 1_000_000      # cells of a block after which it takes no more batches
PART_CELLS = 16_000_000     # cells of a partition of blocks, at most
FEW_PARTS = 16              # partial sums of up to this many partitions are added on the driver


class Prepared(NamedTuple):
    """The EM input: a wide table, its number of partitions, and its cached blocks if they are laid out already."""
    table: DataFrame
    parts: int
    blocks: DataFrame | None = None


BLOCK_SCHEMA = "block binary"


def wide_blocks(table: DataFrame, ycols: Sequence[str]) -> DataFrame:
    """Rows of outcome columns laid out once for all passes, in blocks of about BLOCK_CELLS (see ``read_block``)."""
    from trajectra.session import ship_package
    ship_package(table.sparkSession)
    cols = list(ycols)

    def run(batches):
        kept, cells = [], 0
        for pdf in itertools.chain(batches, [None]):
            if kept and (pdf is None or cells >= BLOCK_CELLS):
                yield pd.DataFrame({"block": [written_block(wide_block(np.concatenate(kept)))]})
                kept, cells = [], 0
            if pdf is not None and len(pdf):
                kept.append(pdf[cols].to_numpy(dtype=float, na_value=np.nan))
                cells += kept[-1].size

    return table.select(*cols).mapInPandas(run, BLOCK_SCHEMA)


def written_block(v: Block) -> bytes:
    """A block as bytes, pattern by pattern: cells without a value, and squares of single values, are left out."""
    seen = lambda x: np.concatenate([x[v.O[j] > 0, of].ravel() for j, of in enumerate(_of_patterns(v))] or [x.ravel()])
    return pickle.dumps(tuple(v._replace(y=seen(v.y), yy=seen(v.yy) if v.O.max(initial=0.0) > 1 else None, at=None)), protocol=5)


def read_block(x: bytes) -> Block:
    v = Block(*pickle.loads(x))
    v = v._replace(at=np.repeat(np.arange(len(v.O)), np.diff(np.append(v.first, len(v.weight)))))

    def whole(values):
        out, lo = np.zeros((v.O.shape[1], len(v.weight))), 0
        for j, of in enumerate(_of_patterns(v)):
            waves = np.flatnonzero(v.O[j])
            hi = lo + len(waves) * (of.stop - of.start)
            out[waves, of] = values[lo:hi].reshape(len(waves), of.stop - of.start)
            lo = hi
        return out

    y = whole(v.y)
    return v._replace(y=y, yy=y * y if v.yy is None else whole(v.yy))


def _of_patterns(v: Block) -> list[slice]:
    """The subjects of each pattern."""
    return [slice(lo, hi) for lo, hi in zip(v.first, [*v.first[1:], len(v.weight)])]


def em_pass(panel: Prepared, ycols: Sequence[str], times: Sequence[float], params: list[dict]) -> dict:
    """One EM pass over the panel for all groups: returns summed M-step statistics.

    ``mapInPandas`` runs the closed-form E step vectorised over each Arrow batch
    for every group and class at once and emits the partition's sums.  A few partitions send
    theirs to the driver; the sums of many are first added up in Spark by (group,
    class, slot), so the driver receives a fixed groups x classes x (3W + 11) numbers.
    """
    from trajectra.session import ship_package
    ship_package(panel.table.sparkSession)
    Z = design(times)
    P = _pack(params)
    G, K = P["a"].shape[0], P["a"].shape[1]
    W = len(ycols)
    sl = _slots(W)
    few = panel.parts <= FEW_PARTS

    def run(batches):
        acc = np.zeros((G, K, 3 * W + 11))
        for pdf in batches:
            for x in pdf["block"]:
                sums, ll, _ = grid_sums(read_block(x), Z, P["a"], P["th"], P["psi"], P["pi"], scores=False)
                acc[:, :, :sl["sp"].stop] += sums[:, :, :sl["sp"].stop]
                acc[:, 0, sl["ll"]] += ll[:, None]
        if few:
            yield pd.DataFrame({"sums": [acc.tobytes()]})
        else:
            yield pd.DataFrame({"cell": np.arange(acc.size), "value": acc.ravel()})

    rows = panel.blocks if panel.blocks is not None else wide_blocks(panel.table, ycols)
    if few:
        vecs = sum(np.frombuffer(r["sums"]) for r in rows.mapInPandas(run, "sums binary").collect())
    else:
        sums = rows.mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        vecs = np.zeros(G * K * (3 * W + 11))
        for r in sums.collect():
            vecs[r["cell"]] = r["value"]
    vecs = np.asarray(vecs, dtype=float).reshape(G, K, 3 * W + 11)
    return {"sw": vecs[:, :, sl["sw"]], "sy": vecs[:, :, sl["sy"]], "syy": vecs[:, :, sl["syy"]],
            "sbb": vecs[:, :, sl["sbb"]].reshape(G, K, 3, 3), "sp": vecs[:, :, sl["sp"]][:, :, 0],
            "ll": vecs[:, 0, sl["ll"]][:, 0]}


def _inverse_2x2(P: np.ndarray) -> np.ndarray:
    """Inverse by the determinant: no error where a covariance is singular to working precision."""
    det = P[0, 0] * P[1, 1] - P[0, 1] ** 2
    return np.array([[P[1, 1], -P[0, 1]], [-P[0, 1], P[0, 0]]]) / det


def _ci_objective(theta: np.ndarray, S: np.ndarray, n: np.ndarray) -> float:
    K = len(n)
    f = 0.0
    for k in range(K):
        P = np.array([[theta[k], theta[K]], [theta[K], theta[K + 1]]])
        det = P[0, 0] * P[1, 1] - P[0, 1] ** 2
        # a determinant within the rounding of its two products is a singular covariance
        if not P[0, 0] > 0 or not det > 4 * np.finfo(float).eps * abs(P[0, 0] * P[1, 1]):
            return np.inf
        f += n[k] * np.log(det) + np.trace(_inverse_2x2(P) @ S[k])
    return f


def _ci_gradient(theta: np.ndarray, S: np.ndarray, n: np.ndarray) -> np.ndarray:
    K = len(n)
    g = np.zeros(K + 2)
    for k in range(K):
        P = np.array([[theta[k], theta[K]], [theta[K], theta[K + 1]]])
        Pi = _inverse_2x2(P)
        G = n[k] * Pi - Pi @ S[k] @ Pi
        g[k] = G[0, 0]
        g[K] += 2.0 * G[0, 1]
        g[K + 1] += G[1, 1]
    return g


def ci_psi_step(S: np.ndarray, n: np.ndarray, old: np.ndarray, steps: int = 8) -> np.ndarray:
    """M step for class-specific intercept variance with shared slope variance and
    intercept-slope covariance (``c. i``): no closed form, so a few damped Newton
    steps (analytic gradient, numerical Hessian, backtracking) on
    sum_k n_k ln|Psi_k| + tr(Psi_k^-1 S_k) from the current value.  The objective
    never increases, so the EM stays a generalised EM (the likelihood cannot fall).
    S: (K, 2, 2) sums of p (b b' + D); n: (K,) class weights; old: (K, 2, 2).
    """
    K = len(n)
    theta = np.array([old[k, 0, 0] for k in range(K)] + [old[0, 0, 1], old[0, 1, 1]], dtype=float)
    if not np.isfinite(_ci_objective(theta, S, n)):
        pooled = S.sum(0) / n.sum()
        theta = np.array([max(S[k, 0, 0] / max(n[k], 1e-12), 1e-6) for k in range(K)]
                         + [pooled[0, 1] * 0.5, max(pooled[1, 1], 1e-6)])
    f0 = _ci_objective(theta, S, n)
    for _ in range(steps):
        g = _ci_gradient(theta, S, n)
        h = 1e-6 * np.maximum(np.abs(theta), 1e-3)
        H = np.stack([(_ci_gradient(theta + h[j] * np.eye(K + 2)[j], S, n)
                       - _ci_gradient(theta - h[j] * np.eye(K + 2)[j], S, n)) / (2 * h[j])
                      for j in range(K + 2)], axis=1)
        H = 0.5 * (H + H.T)
        try:
            d = -np.linalg.solve(H, g) if np.all(np.linalg.eigvalsh(H) > 0) else -g / max(np.abs(g).max(), 1.0)
        except np.linalg.LinAlgError:
            d = -g / max(np.abs(g).max(), 1.0)
        t, improved = 1.0, False
        while t > 1e-8:
            f1 = _ci_objective(theta + t * d, S, n)
            if f1 < f0:
                theta, f0, improved = theta + t * d, f1, True
                break
            t *= 0.5
        if not improved:
            break
    out = np.zeros((K, 2, 2))
    for k in range(K):
        out[k] = [[theta[k], theta[K]], [theta[K], theta[K + 1]]]
    return out


def mstep(s: dict, g: int, old: dict, Z: np.ndarray, factors: Sequence[int], free_re: Sequence[int],
          per_class, shared_residual: bool, floor: float = 1e-6) -> dict:
    """Driver-side M step for one group from the summed statistics."""
    K, W = s["sw"].shape[1], s["sw"].shape[2]
    sw, sy, syy, sbb, sp = s["sw"][g], s["sy"][g], s["syy"][g], s["sbb"][g], s["sp"][g]
    th = old["th"]
    fi = list(factors)
    a = np.zeros((K, 3))
    for k in range(K):
        A = np.einsum("t,ta,tb->ab", sw[k] / th, Z, Z)[np.ix_(fi, fi)]
        rhs = (Z.T @ (sy[k] / th))[fi]
        try:
            a[k, fi] = np.linalg.solve(A, rhs)
        except np.linalg.LinAlgError:
            a[k] = old["a"][k]
    m = a @ Z.T                                    # (K, W)
    num = (syy - 2 * m * sy + m * m * sw).sum(0)   # (W,)
    nt = sw.sum(0)
    th_new = np.full(W, num.sum() / max(nt.sum(), 1e-300)) if shared_residual else num / np.maximum(nt, 1e-300)
    th_new = np.maximum(th_new, floor)
    N = sp.sum()
    psi = np.zeros((K, 3, 3))
    fr = list(free_re)
    if fr and per_class == "i":
        psi[:, :2, :2] = ci_psi_step(sbb[:, :2, :2], sp, old["psi"][:, :2, :2])
    elif fr:
        pooled = sbb.sum(0) / N
        for k in range(K):
            blk = sbb[k] / max(sp[k], 1e-300) if per_class is True else pooled
            psi[k][np.ix_(fr, fr)] = blk[np.ix_(fr, fr)]
    pi = np.maximum(sp / N, 1e-12)
    return {"a": a, "th": th_new, "psi": psi, "pi": pi / pi.sum()}


def start_values(wide: DataFrame, ycols: Sequence[str], K: int, n_starts: int, seed: int,
                 factors: Sequence[int], free_re: Sequence[int]) -> list[dict]:
    """Starting values from one aggregate of the panel (per-wave mean and variance); see ``starts_from``."""
    aggs = []
    for c in ycols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    r = wide.agg(*aggs).first()
    mu = np.array([r[f"m_{c}"] if r[f"m_{c}"] is not None else 0.0 for c in ycols])
    var = np.array([r[f"v_{c}"] if r[f"v_{c}"] is not None else 1.0 for c in ycols])
    return starts_from(mu, var, K, n_starts, seed, factors, free_re)


def starts_from(mu: np.ndarray, var: np.ndarray, K: int, n_starts: int, seed: int, factors: Sequence[int],
                free_re: Sequence[int]) -> list[dict]:
    """Starting values from the mean and variance of each wave.

    Start 0 spreads the class intercepts evenly over +-1 sd; the other (seeded)
    random starts draw intercepts over +-1.5 sd, slopes and curvature on the data's
    scale, random variance scales and class shares.
    """
    base, sd = float(np.nanmean(mu)), float(np.sqrt(np.nanmean(var)))
    rng = np.random.default_rng(seed)
    W = len(mu)
    out = []
    for s in range(n_starts):
        a = np.zeros((K, 3))
        if s == 0:
            a[:, 0] = base + (np.linspace(-1.0, 1.0, K) if K > 1 else np.zeros(1)) * sd
        else:
            # random starts: class intercepts spread over +-1.5 sd, slopes and curvature
            # on the scale of the data over the observed waves
            a[:, 0] = np.sort(rng.uniform(base - 1.5 * sd, base + 1.5 * sd, K))
            if 1 in factors:
                a[:, 1] = rng.normal(0.0, sd / W, K)
            if 2 in factors:
                a[:, 2] = rng.normal(0.0, sd / (W * W), K)
        a[:, [f for f in range(3) if f not in factors]] = 0.0
        psi = np.zeros((K, 3, 3))
        for f in free_re:
            psi[:, f, f] = (0.25 * sd * sd) / (1.0 + 10.0 * f * f) * (1.0 if s == 0 else rng.uniform(0.2, 1.5))
        th = np.maximum(0.5 * var, 1e-3)
        pi = np.full(K, 1.0 / K) if s == 0 else rng.dirichlet(np.full(K, 4.0))
        out.append({"a": a, "th": th, "psi": psi, "pi": pi})
    return out


def _psd_block(m: np.ndarray, free: Sequence[int]) -> np.ndarray:
    """Symmetrise, keep the free block, clip negative eigenvalues (valid covariance)."""
    out = np.zeros((3, 3))
    fr = list(free)
    if fr:
        b = 0.5 * (m + m.T)[np.ix_(fr, fr)]
        w, v = np.linalg.eigh(b)
        out[np.ix_(fr, fr)] = (v * np.maximum(w, 0.0)) @ v.T
    return out


def to_vec(p: dict) -> np.ndarray:
    """Parameters -> unconstrained vector (log variances, log shares)."""
    return np.concatenate([p["a"].ravel(), np.log(p["th"]), p["psi"].ravel(), np.log(p["pi"])])


def from_vec(v: np.ndarray, K: int, W: int, factors: Sequence[int], free_re: Sequence[int]) -> dict:
    i = 0
    a = v[i:i + 3 * K].reshape(K, 3).copy(); i += 3 * K
    a[:, [f for f in range(3) if f not in factors]] = 0.0
    th = np.exp(np.clip(v[i:i + W], -30, 30)); i += W
    psi = np.stack([_psd_block(m, free_re) for m in v[i:i + 9 * K].reshape(K, 3, 3)]); i += 9 * K
    lp = v[i:i + K]
    pi = np.exp(lp - lp.max())
    return {"a": a, "th": th, "psi": psi, "pi": pi / pi.sum()}


SHRINK = 1e-4               # of a residual variance: an extrapolation that takes it further is not believed


def squarem_search(params: list[dict], K: int, W: int, factors, free_re, max_iter: int, tol: float, history: list):
    """SQUAREM-accelerated EM (Varadhan and Roland, 2008) over several groups at once, as a generator.

    It yields the parameter sets whose EM step it needs and is sent ``(F(ps), ll(ps))``
    for them, so whoever drives it can answer several searches by one pass over the
    data.  A cycle costs three passes: two EM steps, an extrapolation along them and a
    stabilising EM step from the extrapolated point; when that point's likelihood
    falls below the plain step's, the plain two-step result is kept, so the likelihood
    never decreases.  So it is when a residual variance falls to less than ``SHRINK`` of
    the plain step's: the likelihood of such a point is a difference of numbers so large
    that their rounding passes for a gain.  Each group stops by itself: once its
    likelihood has settled, or is not finite, later passes leave it out.

    Returns the parameters, the passes, and which groups have settled.
    """
    evals = 0
    params = list(params)
    prev = np.full(len(params), np.nan)
    shown = np.full(len(params), -np.inf)
    settled = np.zeros(len(params), dtype=bool)
    going = np.ones(len(params), dtype=bool)
    while evals < max_iter and going.any():
        at = np.flatnonzero(going)
        p0 = [params[g] for g in at]
        p1, ll0 = yield p0
        p2, ll1 = yield p1
        evals += 2
        ext = []
        for i in range(len(at)):
            v0, v1, v2 = to_vec(p0[i]), to_vec(p1[i]), to_vec(p2[i])
            if not np.isfinite([v0, v1, v2]).all():
                ext.append(p2[i])
                continue
            r = v1 - v0
            d = v2 - 2 * v1 + v0
            nr, nd = np.sqrt(r @ r), np.sqrt(d @ d)
            alpha = -nr / nd if nd > 0 else -1.0
            alpha = min(alpha, -1.0)
            e = from_vec(v0 - 2 * alpha * r + alpha * alpha * d, K, W, factors, free_re)
            ext.append(e if all(np.isfinite(x).all() for x in e.values()) else p2[i])
        p3, ll_ext = yield ext
        evals += 1
        for ll in (ll0, ll1):
            shown[at] = np.where(np.isfinite(ll), ll, shown[at])
            history.append(shown.copy())
        for i, g in enumerate(at):
            better = np.isfinite(ll_ext[i]) and ll_ext[i] >= ll1[i] and bool((ext[i]["th"] >= SHRINK * p2[i]["th"]).all())
            params[g] = p3[i] if better else p2[i]
            cur = ll_ext[i] if better else ll1[i]
            if not np.isfinite(cur):
                going[g] = False
            elif abs(cur - prev[g]) <= tol * max(1.0, abs(cur)):
                settled[g], going[g] = True, False
            prev[g] = cur
    return params, evals, settled


def drive(search, step):
    """Run a search by itself: ``step`` answers each of its questions.  Returns the search's result."""
    try:
        ask = next(search)
        while True:
            ask = search.send(step(ask))
    except StopIteration as end:
        return end.value


def squarem(step, params: list[dict], K: int, W: int, factors, free_re, max_iter: int, tol: float,
            history: list) -> tuple[list[dict], int, np.ndarray]:
    """``squarem_search`` with one EM map ``step(ps) -> (F(ps), ll(ps))``."""
    return drive(squarem_search(params, K, W, factors, free_re, max_iter, tol, history), step)


def starts_search(params: list[dict], K: int, W: int, factors, free_re, keep: int, stage1_iter: int, max_iter: int, tol: float):
    """Multi-start search of one model, as a generator like ``squarem_search``.

    Stage 1 takes every start ``stage1_iter`` steps on; the best ``keep`` go on until
    each has settled.  Starts whose likelihood is not finite are dropped.  Returns the
    result described in ``fit_em``; kept: the number of the start behind each kept one.
    """
    history: list = []
    order = list(range(len(params)))
    if len(params) > keep:
        ll = np.full(len(params), -np.inf)
        for _ in range(stage1_iter):
            params, ll = yield params
            history.append(np.array(ll))
        order = [int(i) for i in np.argsort(-np.where(np.isfinite(ll), ll, -np.inf), kind="stable") if np.isfinite(ll[i])][:keep]
        if not order:
            raise ValueError("no start has a finite log-likelihood")
        params = [params[i] for i in order]
    params, passes, settled = yield from squarem_search(params, K, W, factors, free_re, max_iter, tol, history)
    # a likelihood belongs to the parameters before its M step: one more E pass for the final one
    _, final = yield params
    final = np.asarray(final, dtype=float)
    if not np.isfinite(final).any():
        raise ValueError("no start has a finite log-likelihood")
    best = int(np.nanargmax(np.where(np.isfinite(final), final, np.nan)))
    return {"params": params[best], "ll": float(final[best]), "converged": bool(settled[best]),
            "best_replicated": bool((np.round(final, 3) == np.round(final[best], 3)).sum() >= 2),
            "start_lls": final.tolist(), "start_converged": settled.tolist(), "kept": order, "iterations": passes,
            "all_params": params, "history": history}


def with_values(wide: DataFrame, ycols: Sequence[str]) -> DataFrame:
    """The rows that have a value in at least one of the outcome columns."""
    return wide.where(F.coalesce(*[F.col(c).cast("double") for c in ycols], F.lit(None).cast("double")).isNotNull())


def prepare_panel(wide: DataFrame, ycols: Sequence[str], subject: str = "subject") -> Prepared:
    """The EM input: subject + outcome columns, staged in the checkpoint folder
    (lineage cut; lost executors re-read it rather than recompute the shuffle)
    and cached for the many passes.  A small panel is spread over few partitions, as
    a pass over it is mostly task overhead; a large one over all the cluster's cores
    and more, so that a partition stays small.  Subjects without any value take no part.
    Blocks of subjects, not their columns, are cached: the passes read nothing else."""
    table = stage(with_values(wide, ycols).select(subject, *ycols), "panel")
    rows = table.count()
    parts = max(1, min(wide.sparkSession.sparkContext.defaultParallelism, rows // 2_000), rows // 500_000, rows * len(ycols) // PART_CELLS)
    return Prepared(table, parts, wide_blocks(table.repartition(parts), ycols).persist())


def _structure(restriction: str | None, factors: Sequence[int]):
    return (tuple(factors), False) if restriction is None else RESTRICTION_SPEC[restriction]


def em_steps(wide: DataFrame, ycols: Sequence[str], restriction: str | None, start_params: list[dict], steps: int,
             factors: Sequence[int] = (0, 1, 2), shared_residual: bool = False,
             times: Sequence[float] | None = None) -> tuple[list[dict], np.ndarray]:
    """A fixed number of plain EM steps from given parameters, for all starts at once.

    Returns the parameters after the last step and each start's log-likelihood
    at the parameters before it.
    """
    times = list(times) if times is not None else list(range(len(ycols)))
    free_re, per_class = _structure(restriction, factors)
    panel, params, ll = prepare_panel(wide, ycols), list(start_params), None
    for _ in range(steps):
        s = em_pass(panel, ycols, times, params)
        params = [mstep(s, g, params[g], design(times), factors, free_re, per_class, shared_residual)
                  for g in range(len(params))]
        ll = s["ll"]
    panel.blocks.unpersist()
    return params, ll


def fit_em(wide: DataFrame, ycols: Sequence[str], K: int, restriction: str | None,
           factors: Sequence[int] = (0, 1, 2), shared_residual: bool = False,
           times: Sequence[float] | None = None, n_starts: int = 100, keep: int = 20,
           stage1_iter: int = 10, max_iter: int = 500, tol: float = 1e-7, seed: int = 0,
           start_params: list[dict] | None = None) -> dict:
    """M6/M7/M8: EM for class growth / growth mixtures with multiple starts.

    Stage 1 runs ``n_starts`` starts for ``stage1_iter`` steps in the same passes;
    the best ``keep`` continue until each has settled (|delta LL| <= tol * |LL|) or
    ``max_iter`` passes are done.  Starts whose likelihood is not finite are dropped.

    Returns the best fit (params, ll, converged), the final LL of every kept start
    and whether it settled (start_lls, start_converged), best_replicated (another
    start ends at the same LL to three decimals), passes and the LL history.
    """
    times = list(times) if times is not None else list(range(len(ycols)))
    Z = design(times)
    free_re, per_class = _structure(restriction, factors)
    panel = prepare_panel(wide, ycols)
    params = start_params or start_values(panel.table, ycols, K, n_starts, seed, factors, free_re)

    def step(ps):
        s = em_pass(panel, ycols, times, ps)
        new = [mstep(s, g, ps[g], Z, factors, free_re, per_class, shared_residual) for g in range(len(ps))]
        return new, s["ll"]

    out = drive(starts_search(params, K, len(ycols), factors, free_re, keep, stage1_iter, max_iter, tol), step)
    panel.blocks.unpersist()
    return out


def count_parameters(K: int, factors: Sequence[int], restriction: str | None, shared_residual: bool, W: int) -> int:
    """Free parameters (A15 rule) of a fitted spec."""
    f = len(factors)
    if restriction is None:
        psi = f * (f + 1) // 2
    else:
        psi = {"iq@0": 0, "sq@0": 1, " q@0": 3, "c. i": K + 2, "c.is": 3 * K}[restriction]
    return K * f + psi + (1 if shared_residual else W) + K - 1


# ----------------------------------------------------------------- M3/M4 on pattern statistics

def _pattern_arrays(rows, W):
    pats = []
    for r in rows:
        obs = [t for t in range(W) if r["pattern"][t] == "x"]
        if not obs:
            continue
        n = float(r["n"])
        s1 = np.array([r[f"s_{t}"] for t in obs])
        s2 = np.array([[r[f"ss_{max(t, u)}_{min(t, u)}"] for u in obs] for t in obs])
        pats.append((obs, n, s1, s2))
    return pats


def _lgca_step(pats, W, Z, fi, shared_residual, p):
    """One EM step of the one-class model on pattern statistics; returns (new, ll at p)."""
    a, th, psi = p["a"][0], p["th"], p["psi"][0]
    N = sum(n for _, n, _, _ in pats)
    ll = 0.0
    A = np.zeros((3, 3)); rhs = np.zeros(3)
    sw = np.zeros(W); sy = np.zeros(W); syy = np.zeros(W); sbb = np.zeros((3, 3))
    for obs, n, s1, s2 in pats:
        Zo = Z[obs]; tho = th[obs]
        V = Zo @ psi @ Zo.T + np.diag(tho)
        Vi = np.linalg.inv(V)
        mu_o = Zo @ a
        Cp = s2 - np.outer(s1, mu_o) - np.outer(mu_o, s1) + n * np.outer(mu_o, mu_o)
        _, logdet = np.linalg.slogdet(V)
        ll += -0.5 * (n * (len(obs) * LN2PI + logdet) + np.trace(Vi @ Cp))
        Kg = psi @ Zo.T @ Vi                     # gain: b = Kg (y - mu)
        Dp = psi - Kg @ Zo @ psi                 # posterior covariance
        sbb += Kg @ Cp @ Kg.T + n * Dp           # sum of b b' + D
        # residuals r = y - Z b = A y + c are linear in y: sums from the pattern's s1, s2
        Am = np.eye(len(obs)) - Zo @ Kg
        c = Zo @ (Kg @ mu_o)
        As1 = Am @ s1
        r1 = As1 + n * c
        rr = np.diag(Am @ s2 @ Am.T) + 2 * As1 * c + n * c * c
        zdz = np.einsum("ta,ab,tb->t", Zo, Dp, Zo)
        sw[obs] += n; sy[obs] += r1; syy[obs] += rr + n * zdz
        A += np.einsum("t,ta,tb->ab", n / tho, Zo, Zo)
        rhs += Zo.T @ (r1 / tho)
    a_new = np.zeros(3)
    a_new[fi] = np.linalg.solve(A[np.ix_(fi, fi)], rhs[fi])
    m = Z @ a_new
    num = syy - 2 * m * sy + m * m * sw
    th_new = np.full(W, num.sum() / sw.sum()) if shared_residual else num / np.maximum(sw, 1e-300)
    psi_new = np.zeros((3, 3))
    psi_new[np.ix_(fi, fi)] = (sbb / N)[np.ix_(fi, fi)]
    return {"a": a_new[None], "th": np.maximum(th_new, 1e-6), "psi": psi_new[None], "pi": np.ones(1)}, ll


def _lgca_em(pats, W, Z, factors, shared_residual, max_iter, tol):
    fi = list(factors)
    # start: means from the pooled wave means, variances from the wave variances
    tot1 = np.zeros(W); cnt = np.zeros(W); tot2 = np.zeros(W)
    for obs, n, s1, s2 in pats:
        tot1[obs] += s1; cnt[obs] += n; tot2[obs] += np.diag(s2)
    mu = tot1 / np.maximum(cnt, 1)
    var = np.maximum(tot2 / np.maximum(cnt, 1) - mu * mu, 1e-3)
    a = np.zeros(3)
    a[0] = float(np.average(mu, weights=cnt))
    th = 0.5 * var if not shared_residual else np.full(W, 0.5 * var.mean())
    psi = np.zeros((3, 3))
    for f in fi:
        psi[f, f] = 0.5 * var.mean() / (1.0 + 10.0 * f * f)
    p = [{"a": a[None], "th": th, "psi": psi[None], "pi": np.ones(1)}]

    def step(ps):
        new, ll = _lgca_step(pats, W, Z, fi, shared_residual, ps[0])
        return [new], np.array([ll])

    history: list = []
    p, it, settled = squarem(step, p, 1, W, fi, fi, max_iter, tol, history)
    _, ll = _lgca_step(pats, W, Z, fi, shared_residual, p[0])
    return {"a": p[0]["a"][0], "th": p[0]["th"], "psi": p[0]["psi"][0], "ll": ll, "iterations": it,
            "converged": bool(settled[0])}


MAX_PATTERNS = 5_000        # missing patterns whose sums the driver takes in


def _pattern_sums(wide: DataFrame, ycols: Sequence[str]):
    """Sums per missing pattern on the driver, or None when more patterns occur than it takes in."""
    from trajectra.operators.describe import missing_patterns, pattern_stats
    if missing_patterns(wide, ycols).limit(MAX_PATTERNS + 1).count() > MAX_PATTERNS:
        return None
    return _pattern_arrays(pattern_stats(wide, ycols).collect(), len(ycols))


def growth_curve(wide: DataFrame, ycols: Sequence[str], factors: Sequence[int] = (0, 1),
                 shared_residual: bool = False, times: Sequence[float] | None = None,
                 max_iter: int = 5000, tol: float = 1e-11) -> dict:
    """M3/M4: one-class latent growth curve (random i | i s | i s q, residuals
    equal or free per wave) by maximum likelihood.

    A14 gives n, sums and cross products per missing pattern, and EM runs on the
    driver over those matrices only.  A panel with more than ``MAX_PATTERNS``
    patterns is fitted by the distributed passes of ``fit_em`` instead.
    """
    W = len(ycols)
    times = list(times) if times is not None else list(range(W))
    wide = with_values(wide, ycols)
    pats = _pattern_sums(wide, ycols)
    if pats is None:
        f = fit_em(wide, ycols, 1, None, factors, shared_residual, times, n_starts=1, keep=1, max_iter=max_iter, tol=tol)
        fit = {"a": f["params"]["a"][0], "th": f["params"]["th"], "psi": f["params"]["psi"][0], "ll": f["ll"],
               "iterations": f["iterations"], "converged": f["converged"], "n": wide.count()}
    else:
        fit = _lgca_em(pats, W, design(times), factors, shared_residual, max_iter, tol)
        fit["n"] = int(sum(n for _, n, _, _ in pats))
    fit["parameters"] = count_parameters(1, factors, None, shared_residual, W)
    return fit


def growth_curve_steps(wide: DataFrame, ycols: Sequence[str], start: dict, steps: int, factors: Sequence[int] = (0, 1),
                       shared_residual: bool = False, times: Sequence[float] | None = None) -> tuple[dict, float]:
    """A fixed number of plain EM steps of ``growth_curve`` from given parameters (a, th, psi, pi).

    Returns the parameters after the last step and the log-likelihood before it.
    """
    W = len(ycols)
    Z = design(list(times) if times is not None else list(range(W)))
    wide = with_values(wide, ycols)
    pats = _pattern_sums(wide, ycols)
    if pats is None:
        params, ll = em_steps(wide, ycols, None, [start], steps, factors, shared_residual, times)
        return params[0], float(ll[0])
    ll = None
    for _ in range(steps):
        start, ll = _lgca_step(pats, W, Z, list(factors), shared_residual, start)
    return start, ll


def params_frame(spark, fit: dict, K: int, W: int, group: str = "fit"):
    """Fitted parameters as a long parameter table (group, class, a0.., th_t.., p.., lnpi)."""
    from trajectra.functions.mixed import IDX
    rows = []
    p = fit["params"] if "params" in fit else {"a": fit["a"][None], "th": fit["th"], "psi": fit["psi"][None],
                                               "pi": np.ones(1)}
    for k in range(K):
        r = {"group": group, "class": k + 1, "a0": float(p["a"][k][0]), "a1": float(p["a"][k][1]),
             "a2": float(p["a"][k][2])}
        r.update({f"th_{t}": float(p["th"][t]) for t in range(W)})
        r.update({f"p{a}{b}": float(p["psi"][k][a, b]) for a, b in IDX})
        r["lnpi"] = float(np.log(p["pi"][k]))
        rows.append(r)
    return spark.createDataFrame(pd.DataFrame(rows))

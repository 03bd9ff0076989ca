"""Registered queries: model fitting on panel P.

Every fitter has queries of a fixed number of EM steps from fixed starts, with the
same steps unrolled in SQL (``em_sql``).  The full fits iterate until they settle
and so have no SQL; their maths is tested against brute-force likelihoods in
``tests/test_fit.py``.  The iterations run when the query is built (each needs the
sums of the one before); the result is the small table of the fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trajectra.operators import compare as CM
from trajectra.operators import fit as FT
from trajectra.operators import score as S
from trajectra.plans.em_sql import RESULT_SQL, em_steps_sql
from trajectra.plans.panels import panel_p, wide_p, y_cols
from trajectra.plans.registry import query

# The reference estimator's settings: 100 random starts of which 20 are carried on, 10
# initial-stage iterations, at most 500 iterations, relative log-likelihood change 1e-7.
EM = dict(n_starts=100, keep=20, max_iter=500, tol=1e-7, stage1_iter=10)

FIT_SCHEMA = ("class int, i double, s double, q double, share double, var_i double, ll double, "
              "parameters int, converged boolean, best_replicated boolean")


def _frame(spark, rows, schema):
    return spark.createDataFrame(pd.DataFrame(rows), schema)


def _curve_rows(f: dict, K: int, parameters: int) -> list[dict]:
    p = f["params"]
    return [{"class": k + 1, "i": float(p["a"][k][0]), "s": float(p["a"][k][1]), "q": float(p["a"][k][2]),
             "share": float(p["pi"][k]), "var_i": float(p["psi"][k][0, 0]), "ll": f["ll"], "parameters": parameters,
             "converged": f["converged"], "best_replicated": f["best_replicated"]} for k in range(K)]


def _growth(spark, sf, factors, shared):
    w = wide_p(spark, sf)
    f = FT.growth_curve(w, y_cols(w), factors, shared)
    rows = [{"parameter": n, "estimate": float(v)} for n, v in
            [("i", f["a"][0]), ("s", f["a"][1]), ("q", f["a"][2])]
            + [(f"psi_{a}{b}", f["psi"][a, b]) for a in range(3) for b in range(a, 3)]
            + [(f"theta_{t}", v) for t, v in enumerate(f["th"])]
            + [("ll", f["ll"]), ("parameters", f["parameters"]), ("n", f["n"]), ("converged", f["converged"])]]
    return _frame(spark, rows, "parameter string, estimate double")


@query("m4_growth_curve")
def m4_growth_curve(spark, sf):
    """Linear latent growth curve, residuals free per wave (pattern statistics + driver EM)."""
    return _growth(spark, sf, (0, 1), False)


@query("m3_mixed_growth")
def m3_mixed_growth(spark, sf):
    """Quadratic random-coefficient growth model with one residual variance (maximum likelihood)."""
    return _growth(spark, sf, (0, 1, 2), True)


def _mixture(spark, sf, K, restriction, seed=7):
    w = wide_p(spark, sf)
    f = FT.fit_em(w, y_cols(w), K, restriction, seed=seed, **EM)
    return f, FT.count_parameters(K, (0, 1, 2), restriction, False, len(y_cols(w))), len(y_cols(w))


@query("m6_class_growth")
def m6_class_growth(spark, sf):
    """Two-class growth model with a random intercept (sq@0), 100 starts."""
    f, p, _ = _mixture(spark, sf, 2, "sq@0")
    return _frame(spark, _curve_rows(f, 2, p), FIT_SCHEMA)


@query("m7_growth_mixture")
def m7_growth_mixture(spark, sf):
    """Two-class growth mixture with random intercept and slope ( q@0), 100 starts."""
    f, p, _ = _mixture(spark, sf, 2, " q@0")
    return _frame(spark, _curve_rows(f, 2, p), FIT_SCHEMA)


@query("m8_multi_start")
def m8_multi_start(spark, sf):
    """Final log-likelihood of every kept start, ranked, with whether it settled and the replicated-best flag."""
    f, _, _ = _mixture(spark, sf, 2, "iq@0")
    starts = _frame(spark, [{"start": i + 1, "ll": float(v), "converged": bool(c)}
                            for i, (v, c) in enumerate(zip(f["start_lls"], f["start_converged"]))],
                    "start int, ll double, converged boolean")
    r = CM.rank_starts(starts.withColumn("model", F.lit("iq@0")), ["model"], "ll", 3)
    return r.select("start", "ll_rounded", F.col("rank").cast("int").alias("rank"), "converged", "best_replicated")


@query("m11_estimated_means")
def m11_estimated_means(spark, sf):
    """Estimated class curves per wave from the fitted two-class model, with class shares."""
    f, _, W = _mixture(spark, sf, 2, "iq@0")
    curves = S.estimated_means(FT.params_frame(spark, f, 2, W), range(W))
    shares = _frame(spark, [{"class": k + 1, "share": float(f["params"]["pi"][k])} for k in range(2)],
                    "class int, share double")
    return curves.join(shares, "class").select(F.col("class").cast("int").alias("class"),
                                               F.col("wave").cast("int").alias("wave"), "mean", "share")


@query("m5_score_fitted")
def m5_score_fitted(spark, sf):
    """Subjects scored with the fitted two-class model: counts by most likely class and
    posterior mass, entropy (fit with EM, then scored with the closed-form column expressions)."""
    f, _, W = _mixture(spark, sf, 2, "iq@0")
    sc = S.to_scores(S.panel_posteriors(panel_p(spark, sf), FT.params_frame(spark, f, 2, W), W, K=2), 2)
    cnt = S.class_counts(sc).select("class", F.col("count").alias("n_most_likely"))
    mass = S.class_mass(sc).select("class", F.col("count").alias("posterior_mass"))
    ent = S.entropy(sc, 2).select("entropy")
    return cnt.join(mass, "class", "full").crossJoin(F.broadcast(ent)).select(
        F.col("class").cast("int").alias("class"), "n_most_likely", "posterior_mass", "entropy")


# ----------------------------------------------------------------- fixed EM steps, with SQL twins

THETA = 150.0


def _class(a, psi=(0.0, 0.0, 0.0), pi=0.5) -> dict:
    return {"a": a, "psi": psi, "pi": pi}


TWO = [[_class((18.0, 0.3, -0.01), (20.0, 0.0, 0.0), 0.4), _class((32.0, -0.2, 0.01), (20.0, 0.0, 0.0), 0.6)]]
TWO_SLOPES = [[_class((18.0, 0.3, -0.01), (20.0, 0.5, 0.4), 0.4), _class((32.0, -0.2, 0.01), (25.0, -0.5, 0.6), 0.6)]]
THREE_STARTS = [[_class((a, 0.1, 0.0), pi=0.5), _class((b, -0.1, 0.0), pi=0.5)] for a, b in ((15.0, 35.0), (20.0, 26.0), (5.0, 28.0))]
ONE = [[_class((24.0, 0.1, 0.0), (30.0, 0.2, 0.5), 1.0)]]


def _params(classes: list[dict], W: int) -> dict:
    """A start as the fitter's arrays."""
    psi = np.zeros((len(classes), 3, 3))
    for k, c in enumerate(classes):
        psi[k, 0, 0], psi[k, 0, 1], psi[k, 1, 0], psi[k, 1, 1] = c["psi"][0], c["psi"][1], c["psi"][1], c["psi"][2]
    return {"a": np.array([c["a"] for c in classes]), "th": np.full(W, THETA), "psi": psi,
            "pi": np.array([c["pi"] for c in classes])}


def _result(spark, params: list[dict], lls, W: int):
    rows = []
    for g, (p, ll) in enumerate(zip(params, lls)):
        for k in range(len(p["pi"])):
            for t in range(W):
                mean = p["a"][k] @ np.array([1.0, t, t * t])
                rows.append((g, k + 1, t, mean, p["th"][t], p["psi"][k][0, 0], p["psi"][k][0, 1], p["psi"][k][1, 1], p["pi"][k], ll))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["start", "class", "wave", "mean", "th", "p00", "p01", "p11", "pi", "ll"]),
                               "start int, class int, wave int, mean double, th double, p00 double, p01 double, p11 double, pi double, ll double")
    return df.select("start", "class", "wave", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in
                                                 ["mean", "th", "p00", "p01", "p11", "pi"]], F.round("ll", 3).alias("ll"))


def _steps(spark, sf, starts, restriction, steps):
    w = wide_p(spark, sf)
    W = len(y_cols(w))
    params, lls = FT.em_steps(w, y_cols(w), restriction, [_params(c, W) for c in starts], steps)
    return _result(spark, params, lls, W)


@query("m6_em_step", sql=em_steps_sql(TWO, THETA, 1, 1) + RESULT_SQL)
def m6_em_step(spark, sf):
    """One EM step of the two-class growth model with a random intercept."""
    return _steps(spark, sf, TWO, "sq@0", 1)


@query("m6_em_steps", sql=em_steps_sql(TWO, THETA, 3, 1) + RESULT_SQL)
def m6_em_steps(spark, sf):
    """Three EM steps of the two-class growth model with a random intercept."""
    return _steps(spark, sf, TWO, "sq@0", 3)


@query("m7_em_steps", sql=em_steps_sql(TWO_SLOPES, THETA, 3, 2) + RESULT_SQL)
def m7_em_steps(spark, sf):
    """Three EM steps of the growth mixture with shared random intercept and slope ( q@0)."""
    return _steps(spark, sf, TWO_SLOPES, " q@0", 3)


@query("m7_em_steps_class_specific", sql=em_steps_sql(TWO_SLOPES, THETA, 3, 2, per_class=True) + RESULT_SQL)
def m7_em_steps_class_specific(spark, sf):
    """Three EM steps of the growth mixture with class-specific intercept and slope variances (c.is)."""
    return _steps(spark, sf, TWO_SLOPES, "c.is", 3)


@query("m8_em_starts", sql=em_steps_sql(THREE_STARTS, THETA, 3, 0) + """,
l AS (SELECT DISTINCT start, round(ll, 3) AS ll FROM em)
SELECT CAST(start AS INTEGER) AS start, ll, CAST(rank() OVER (ORDER BY ll DESC) AS INTEGER) AS rank,
       (SELECT count(*) FROM l b WHERE b.ll = (SELECT max(ll) FROM l)) >= 2 AS best_replicated FROM l""")
def m8_em_starts(spark, sf):
    """Three starts of the class growth model without random effects, three steps each in the same passes, ranked."""
    w = wide_p(spark, sf)
    _, lls = FT.em_steps(w, y_cols(w), "iq@0", [_params(c, len(y_cols(w))) for c in THREE_STARTS], 3)
    starts = _frame(spark, [{"model": "iq@0", "start": g, "ll": float(v)} for g, v in enumerate(lls)], "model string, start int, ll double")
    r = CM.rank_starts(starts, ["model"], "ll", 3)
    return r.select("start", F.col("ll_rounded").alias("ll"), F.col("rank").cast("int").alias("rank"), "best_replicated")


def _growth_steps(spark, sf, shared):
    w = wide_p(spark, sf)
    W = len(y_cols(w))
    p, ll = FT.growth_curve_steps(w, y_cols(w), _params(ONE[0], W), 3, (0, 1), shared)
    return _result(spark, [p], [ll], W)


@query("m4_em_steps", sql=em_steps_sql(ONE, THETA, 3, 2, quadratic=False) + RESULT_SQL)
def m4_em_steps(spark, sf):
    """Three EM steps of the linear latent growth curve, residuals free per wave."""
    return _growth_steps(spark, sf, False)


@query("m3_em_steps", sql=em_steps_sql(ONE, THETA, 3, 2, shared_residual=True, quadratic=False) + RESULT_SQL)
def m3_em_steps(spark, sf):
    """Three EM steps of the linear random-coefficient model with one residual variance."""
    return _growth_steps(spark, sf, True)

"""Parametric bootstrap of class-count tests.

Panels are drawn from the fitted model with one class less, with the observed waves of
every subject; a draw is an outcome of its own, so the fits of all draws, with both
numbers of classes, run in the same passes of the grid.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.operators.grid_fit import Model, Panels, fit_grid, panels_of
from trajectra.session import ship_package

SEPARATOR = "#"


def draw_name(outcome: str, draw: int) -> str:
    return f"{outcome}{SEPARATOR}{draw}"


def simulated(panels: Panels, fits: Sequence[dict], draws: int, seed: int) -> DataFrame:
    """``draws`` panels for the outcome of each fit (one fit per outcome): rows as in the panels, outcome "name#draw".

    Class, random effects and residuals of a subject come from a generator seeded by
    outcome, subject, draw and ``seed``, so reruns and retried tasks agree, whatever
    the partitions.  The panels must not be collapsed (every weight 1).
    """
    ship_package(panels.table.sparkSession)
    params = {f["model"].outcome: f["params"] for f in fits}
    upto = {o: np.cumsum(p["pi"]) / np.cumsum(p["pi"])[-1] for o, p in params.items()}
    roots = {o: [np.linalg.cholesky(c + 1e-12 * np.eye(3)) if c.any() else np.zeros((3, 3)) for c in p["psi"]] for o, p in params.items()}

    def run(batches):
        for pdf in batches:
            for o, part in pdf.groupby("outcome"):
                if o not in params:
                    continue
                p, out = params[o], []
                for subject, t in zip(part["subject"], part["t"]):
                    z = np.power(np.asarray(t, dtype=float)[:, None], np.arange(3)[None])
                    key = zlib.crc32(f"{o}\x00{subject}".encode())
                    for d in range(draws):
                        rng = np.random.default_rng([seed, d, key])
                        k = upto[o].searchsorted(rng.random(), side="right")         # as rng.choice draws
                        effects = p["a"][k] + roots[o][k] @ rng.standard_normal(3)
                        y = z @ effects + np.sqrt(p["th"][t]) * rng.standard_normal(len(t))
                        out.append((draw_name(o, d), subject, t, y, 1.0))
                yield pd.DataFrame(out, columns=["outcome", "subject", "t", "y", "weight"])

    return panels.table.mapInPandas(run, "outcome string, subject string, t array<int>, y array<double>, weight double")


TEST_SCHEMA = ("model string, outcome string, n_classes int, ll_one_less double, lrt double, draws int, successful_draws int, "
               "mean double, p_value double")


def bootstrap_tests(spark, panels: Panels, pairs: Sequence[tuple[dict, dict]], draws: int = 100, seed: int = 11, **search) -> DataFrame:
    """Each (fit with k classes, fit with k - 1) of an outcome: the share of draws from the smaller one whose statistic reaches the fit's.

    p_value: (draws at or above + 1) / (successful draws + 1).  A draw whose statistic
    is negative has not found its larger model's maximum and does not count as
    successful.  ``search``: how the draws' models are searched (see ``fit_grid``).
    """
    if not pairs:
        return spark.createDataFrame([], TEST_SCHEMA)
    drawn = panels_of(simulated(panels, [small for _, small in pairs], draws, seed))
    models = [m._replace(name=draw_name(m.name, d), outcome=draw_name(m.outcome, d)) for pair in pairs for m in (x["model"] for x in pair)
              for d in range(draws)]
    ll = {r["model"].name: r["ll"] for r in fit_grid(drawn, models, seed=seed, **search)}
    drawn.table.unpersist()
    rows = []
    for large, small in pairs:
        m, s = large["model"], small["model"]
        lrt = 2.0 * (large["ll"] - small["ll"])
        each = np.array([2.0 * (ll[draw_name(m.name, d)] - ll[draw_name(s.name, d)]) for d in range(draws)])
        good = each[np.isfinite(each) & (each >= -1e-6)]
        rows.append((m.name, m.outcome, m.classes, float(small["ll"]), float(lrt), draws, len(good),
                     float(good.mean()) if len(good) else None, float((1 + (good >= lrt).sum()) / (1 + len(good)))))
    return spark.createDataFrame(rows, TEST_SCHEMA)

"""Registered queries: a grid of class growth models over every outcome of panel E, fitted in the same passes (M6-M8 over J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajectra.operators import bootstrap as BS
from trajectra.operators import compare as CM
from trajectra.operators import grid as G
from trajectra.operators import grid_fit as GF
from trajectra.operators import information as IN
from trajectra.plans.grid_sql import grid_sql, title
from trajectra.plans.panels import PANEL_E_SQL, panel_e
from trajectra.plans.q_fit import EM
from trajectra.plans.registry import query

CLASSES, RESTRICTIONS, RULES = (1, 2, 3), ("iq@0", "sq@0", " q@0"), (True, False)
STEPS, STARTS = 3, 2

PANEL_G_SQL = PANEL_E_SQL + ",\npanel_g AS (SELECT outcome, subject, wave, y FROM panel_e WHERE y IS NOT NULL)"


def specs(spark, classes=CLASSES, restrictions=RESTRICTIONS, rules=RULES):
    """The spec grid (J6): every combination of the lists, with its title pattern and residual rule."""
    lists = [spark.createDataFrame([(x,) for x in values], f"{name} {kind}") for name, kind, values in
             (("n_classes", "int", classes), ("restriction", "string", restrictions), ("shared_residual", "boolean", rules))]
    rule = F.when(F.col("shared_residual"), "constrained").otherwise("unconstrained")
    g = G.cross_grid(*lists).withColumn("__o", F.lit("%s")).withColumn("__r", rule)
    return G.title(g, "%s-lcga2 - unconditional quadratic model - %s -%d classes-residuals %s",
                   ["__o", "restriction", "n_classes", "__r"], "title")


def fixed_grid(spark, panel, steps=STEPS, starts=STARTS, **lists):
    """The grid after a fixed number of steps, for every outcome of ``panel``."""
    return GF.grid_steps_table(panel, specs(spark, **lists), steps, starts)


GRID_SQL = grid_sql(PANEL_G_SQL, CLASSES, RESTRICTIONS, RULES, STEPS, STARTS)


def _rows(table):
    k, ll = F.col("parameters"), F.col("ll")
    return table.select(
        "model", "outcome", "n_classes", "restriction", "residuals", "n", "waves", "parameters", F.round("ll", 3).alias("ll"),
        F.round(-2.0 * ll + 2.0 * k, 3).alias("aic"), F.round(-2.0 * ll + k * F.log(F.col("n").cast("double")), 3).alias("bic"),
        F.round("entropy", 5).alias("entropy"), "best_start", "best_seed")


@query("m6_grid_steps", sql=GRID_SQL + """
SELECT model, outcome, CAST(classes AS INTEGER) AS n_classes, restriction, residuals, CAST(n AS BIGINT) AS n, CAST(nw AS INTEGER) AS waves,
       CAST(parameters AS INTEGER) AS parameters, round(ll, 3) AS ll, round(-2.0 * ll + 2.0 * parameters, 3) AS aic,
       round(-2.0 * ll + parameters * ln(n), 3) AS bic, round(entropy, 5) AS entropy, CAST(start + 1 AS INTEGER) AS best_start,
       CAST(seed AS BIGINT) AS best_seed
FROM best""")
def m6_grid_steps(spark, sf):
    """One row per model of the grid (outcome, classes, restriction, residual rule), its best start after three steps."""
    return _rows(fixed_grid(spark, panel_e(spark, sf)))


@query("m6_grid_classes", sql=GRID_SQL + """
SELECT model, CAST(class AS INTEGER) AS class, round(a0, 4) + 0.0 AS i, round(a1, 4) + 0.0 AS s, round(a2, 5) + 0.0 AS q, round(se_0, 5) AS se_i, round(se_1, 5) AS se_s,
       round(se_2, 6) AS se_q, round(pi, 5) AS share,
       round(p00, 4) + 0.0 AS var_i, round(posterior_count, 3) AS posterior_count, likely_count
FROM best_classes""")
def m6_grid_classes(spark, sf):
    """The classes of every model of the grid: curve, share, intercept variance, posterior and most likely counts."""
    t = fixed_grid(spark, panel_e(spark, sf)).select("model", F.explode("classes").alias("c"))
    return t.select("model", "c.class", *[(F.round(f"c.{x}", d) + F.lit(0.0)).alias(x) for x, d in
                                          (("i", 4), ("s", 4), ("q", 5), ("se_i", 5), ("se_s", 5), ("se_q", 6), ("share", 5), ("var_i", 4), ("posterior_count", 3))], "c.likely_count")


@query("m6_grid_fit")
def m6_grid_fit(spark, sf):
    """The settled fits of the whole grid over panel E: 100 starts a model, 20 kept, every model and start stopping by itself."""
    panels = GF.stage_panels(panel_e(spark, sf))
    models = GF.grid_models(specs(spark), list(panels.n))
    t = GF.grid_table(spark, GF.fit_grid(panels, models, **EM))
    panels.table.unpersist()
    return _rows(t).join(t.select("model", "converged", "best_replicated"), "model")


# ----------------------------------------------------------------- information matrices (C5, C7, C8 on fits)

def _settled(spark, panel, **lists):
    panels = GF.stage_panels(panel)
    models = GF.grid_models(specs(spark, **lists), list(panels.n))
    return panels, GF.fit_grid(panels, models, n_starts=6, keep=2, stage1_iter=5, max_iter=150)


SCORES_SQL = "WITH" + PANEL_G_SQL + """,
stats AS MATERIALIZED (
  SELECT outcome, avg(m) AS base, sqrt(avg(v)) AS sd FROM (SELECT outcome, wave, avg(y) AS m, var_pop(y) AS v FROM panel_g GROUP BY outcome, wave) w GROUP BY outcome),
par AS (
  SELECT outcome, class, base + sd * off AS a0, 0.25 * sd * sd AS psi, greatest(0.5 * sd * sd, 0.001) AS th
  FROM stats CROSS JOIN (VALUES (1, -1.0), (2, 1.0)) c(class, off)),
s AS (
  SELECT p.outcome, p.subject, c.class, any_value(c.psi) AS psi, any_value(c.th) AS th, count(*) AS n, sum(1.0 / c.th) AS s0, sum(p.wave / c.th) AS s1,
         sum(p.wave * p.wave / c.th) AS s2, sum((p.y - a0) / c.th) AS g0, sum((p.y - a0) * p.wave / c.th) AS g1,
         sum((p.y - a0) * p.wave * p.wave / c.th) AS g2, sum(p.y - a0) AS e, sum((p.y - a0) * (p.y - a0)) AS ee
  FROM panel_g p JOIN par c ON c.outcome = p.outcome GROUP BY p.outcome, p.subject, c.class),
d AS (SELECT *, psi / (1.0 + psi * s0) AS d, psi / (1.0 + psi * s0) * g0 AS b FROM s),
l AS (
  SELECT *, g0 - s0 * b AS u0, g1 - s1 * b AS u1, g2 - s2 * b AS u2, 0.5 * ((ee - 2.0 * b * e + n * b * b) / (th * th) - n / th + n * d / (th * th)) AS t,
         ln(0.5) - 0.5 * (n * ln(2.0 * pi() * th) + ln(1.0 + psi * s0) + ee / th - g0 * b) AS lp FROM d),
w AS MATERIALIZED (SELECT *, exp(lp - max(lp) OVER g) / sum(exp(lp - top)) OVER g AS p
                   FROM (SELECT *, max(lp) OVER (PARTITION BY outcome, subject) AS top FROM l) x WINDOW g AS (PARTITION BY outcome, subject)),
long AS MATERIALIZED (
  SELECT outcome, subject, 'i_' || class AS parameter, p * u0 AS x FROM w UNION ALL SELECT outcome, subject, 's_' || class, p * u1 FROM w
  UNION ALL SELECT outcome, subject, 'q_' || class, p * u2 FROM w
  UNION ALL SELECT outcome, subject, 'psi_ii', sum(p * 0.5 * (u0 * u0 - (s0 - s0 * s0 * d))) FROM w GROUP BY outcome, subject
  UNION ALL SELECT outcome, subject, 'theta', sum(p * t) FROM w GROUP BY outcome, subject
  UNION ALL SELECT outcome, subject, 'logit_1', p - 0.5 FROM w WHERE class = 1)
"""


@query("c7_score_products", sql=SCORES_SQL + """
SELECT a.outcome, a.parameter AS parameter, b.parameter AS other, round(sum(a.x * b.x), 3) + 0.0 AS product
FROM long a JOIN long b ON b.outcome = a.outcome AND b.subject = a.subject GROUP BY a.outcome, a.parameter, b.parameter
UNION ALL SELECT outcome, parameter, '(total)', round(sum(x), 4) + 0.0 FROM long GROUP BY outcome, parameter""")
def c7_score_products(spark, sf):
    """Outer products and totals of the subjects' score vectors at fixed parameters: two classes with a random intercept, per event type."""
    panels = GF.stage_panels(panel_e(spark, sf))
    models = [GF.Model(o, o, 2, "sq@0", shared_residual=True) for o in sorted(panels.n)]
    start = GF.unit_starts(2, 1, 7)[0]
    rows = []
    for m, (total, products) in zip(models, IN.score_products(panels, [[(m, GF.scaled_start(start, panels, m))] for m in models])):
        names = IN.parameter_names(m, panels.waves(m.outcome))
        rows += [(m.outcome, a, b, float(products[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
        rows += [(m.outcome, a, "(total)", float(total[i])) for i, a in enumerate(names)]
    panels.table.unpersist()
    t = spark.createDataFrame(rows, "outcome string, parameter string, other string, product double")
    digits = F.when(F.col("other") == "(total)", F.round("product", 4)).otherwise(F.round("product", 3))
    return t.withColumn("product", digits + F.lit(0.0))


@query("c7_fit_errors")
def c7_fit_errors(spark, sf):
    """Every free parameter of the settled class models of panel E with ordinary and robust errors, z, p and the scaling factor."""
    panels, fits = _settled(spark, panel_e(spark, sf), classes=(1, 2), restrictions=("iq@0", "sq@0"), rules=(True,))
    out = IN.error_table(spark, panels, fits)
    panels.table.unpersist()
    return out


@query("c5_fit_scaled_tests")
def c5_fit_scaled_tests(spark, sf):
    """Robust likelihood-ratio tests between settled fits: a random intercept against none, per outcome and number of classes."""
    panels, fits = _settled(spark, panel_e(spark, sf), classes=(1, 2), restrictions=("iq@0", "sq@0"), rules=(True,))
    t = IN.error_table(spark, panels, fits).groupBy("model", "outcome", "ll", "parameters", "scaling").agg(F.count(F.lit(1)).alias("n_estimates"))
    panels.table.unpersist()
    t = t.withColumn("n_classes", F.regexp_extract("model", r"-(\d+) classes", 1).cast("int"))
    return CM.scaled_lr_test(t, ["outcome", "n_classes"], ["parameters"])


@query("c8_reference_distribution")
def c8_reference_distribution(spark, sf):
    """Class-count tests of settled fits with the mean, deviation and tail of their reference distributions."""
    panels, fits = _settled(spark, panel_e(spark, sf), classes=(1, 2, 3), restrictions=("iq@0",), rules=(True,))
    out = IN.class_count_tests(spark, panels, fits)
    panels.table.unpersist()
    return out


@query("c8_bootstrap_test")
def c8_bootstrap_test(spark, sf):
    """Bootstrapped class-count test of two classes against one for every event type: 19 draws, fitted in the same passes."""
    panels, fits = _settled(spark, panel_e(spark, sf), classes=(1, 2), restrictions=("iq@0",), rules=(True,))
    by = {(f["model"].outcome, f["model"].classes): f for f in fits}
    out = BS.bootstrap_tests(spark, panels, [(by[o, 2], by[o, 1]) for o in sorted(panels.n)], draws=19, n_starts=2, keep=2, max_iter=24, tol=1e-5)
    panels.table.unpersist()
    return out


@query("m7_class_intercepts")
def m7_class_intercepts(spark, sf):
    """Settled growth mixtures with class-specific intercept variances (c. i) and (co)variances (c.is): two classes per event type."""
    panels, fits = _settled(spark, panel_e(spark, sf), classes=(2,), restrictions=("c. i", "c.is"), rules=(True,))
    t = GF.grid_table(spark, fits)
    panels.table.unpersist()
    return t.select("model", "outcome", "restriction", "n", "parameters", "ll", "converged", "best_replicated", F.explode("classes").alias("c")).select(
        "model", "outcome", "restriction", "n", "parameters", "ll", "converged", "best_replicated", "c.class", "c.i", "c.s", "c.q", "c.share", "c.var_i")

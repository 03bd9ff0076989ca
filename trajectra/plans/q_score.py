"""Registered queries: scoring panel P with a fixed two-class model.

The Spark side sums each subject's visits per class and solves the general 3x3
random-effect forms; the DuckDB twin is written for the fixed model's random
intercept alone, where the inverse covariance has a scalar closed form.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from trajectra.operators import score as S
from trajectra.plans.panels import PANEL_P_SQL, panel_p, waves_p
from trajectra.plans.registry import query

K = 2
GROUP = "fixed2"
# Fixed two-class growth model for panel P (y = order price / 10000, about U(0, 50)):
# class means (i, s, q), shared random-intercept variance, class shares; the residual
# variance of wave t is 150 + 5 (t mod 4), for any number of waves.
FLAGSHIP_MEANS = {1: (15.0, 0.2, -0.01), 2: (35.0, -0.2, 0.01)}
FLAGSHIP_PSI_I = 10.0
FLAGSHIP_PI = {1: 0.5, 2: 0.5}


def flagship_theta(t: int) -> float:
    return 150.0 + 5.0 * (t % 4)


def flagship_rows(W: int) -> list[dict]:
    """Long parameter rows (group, class, a0.., th_t.., p.., lnpi)."""
    out = []
    for k in range(1, K + 1):
        a0, a1, a2 = FLAGSHIP_MEANS[k]
        r = {"group": GROUP, "class": k, "a0": a0, "a1": a1, "a2": a2}
        r.update({f"th_{t}": flagship_theta(t) for t in range(W)})
        r.update({"p00": FLAGSHIP_PSI_I, "p01": 0.0, "p02": 0.0, "p11": 0.0, "p12": 0.0, "p22": 0.0})
        r["lnpi"] = math.log(FLAGSHIP_PI[k])
        out.append(r)
    return out


def flagship_params(spark, W: int):
    return spark.createDataFrame(pd.DataFrame(flagship_rows(W)))


def posteriors(spark, sf, W: int | None = None):
    W = W or waves_p(spark, sf)
    return S.panel_posteriors(panel_p(spark, sf), flagship_params(spark, W), W, K=K)


def scores(spark, sf):
    return S.to_scores(posteriors(spark, sf), K)


def _r(c, d=4):
    return F.round(c, d) + F.lit(0.0)   # + 0.0 turns a rounded -0.0 into 0.0


# ----------------------------------------------------------------- SQL twin

_PARAMS = ", ".join(f"({k}, {FLAGSHIP_MEANS[k][0]}, {FLAGSHIP_MEANS[k][1]}, {FLAGSHIP_MEANS[k][2]}, {math.log(FLAGSHIP_PI[k])!r})"
                    for k in range(1, K + 1))
SCORE_SQL = "WITH" + PANEL_P_SQL + f""",
params AS (SELECT * FROM (VALUES {_PARAMS}) v(class, a0, a1, a2, lnpi)),
r AS (SELECT p.subject, c.class, c.a0, c.a1, c.a2, c.lnpi, p.wave, 150.0 + 5.0 * (p.wave % 4) AS th,
             p.y - (c.a0 + c.a1 * p.wave + c.a2 * p.wave * p.wave) AS e FROM panel_p p CROSS JOIN params c),
s AS (SELECT subject, class, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, any_value(lnpi) AS lnpi,
             count(*) AS n, sum(ln(th)) AS lt, sum(e * e / th) AS c, sum(e / th) AS g, 1.0 + {FLAGSHIP_PSI_I} * sum(1.0 / th) AS d
      FROM r GROUP BY subject, class),
f AS (SELECT *, {FLAGSHIP_PSI_I} * g / d AS b0, 0.0 AS b1, 0.0 AS b2, {FLAGSHIP_PSI_I} / d AS D00,
             -0.5 * (n * ln(2.0 * pi()) + lt + ln(d) + c - {FLAGSHIP_PSI_I} * g * g / d) AS logf FROM s),
m AS (SELECT *, logf + lnpi AS lp, max(logf + lnpi) OVER (PARTITION BY subject) AS top FROM f),
l AS (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY subject)) AS ll FROM m),
sc AS (SELECT *, exp(lp - ll) AS posterior, CAST(first_value(class) OVER (PARTITION BY subject ORDER BY lp DESC, class) AS INTEGER) AS most_likely
       FROM l)
"""


# ----------------------------------------------------------------- queries

@query("m5_score", sql=SCORE_SQL + """
SELECT subject, CAST(class AS INTEGER) AS class, round(posterior, 4) AS posterior, most_likely,
       round(ll, 4) AS ll FROM sc""")
def m5_score(spark, sf):
    """Posterior class probabilities, most likely class and log-likelihood per subject."""
    s = scores(spark, sf)
    return s.select("subject", F.col("class").cast("int").alias("class"), _r(F.col("posterior")).alias("posterior"),
                    "most_likely", _r(F.col("ll")).alias("ll"))


@query("j9_expand_classes", sql=SCORE_SQL + """
SELECT subject, CAST(class AS INTEGER) AS class, round(logf, 4) AS logf FROM sc""")
def j9_expand_classes(spark, sf):
    """Subject x class expansion against the size-checked broadcast parameters."""
    s = scores(spark, sf)
    return s.select("subject", F.col("class").cast("int").alias("class"), _r(F.col("logf")).alias("logf"))


@query("w7_most_likely", sql=SCORE_SQL + """
SELECT subject, most_likely, round(posterior, 4) AS ml_posterior FROM sc WHERE class = most_likely""")
def w7_most_likely(spark, sf):
    """Most likely class per subject (ties go to the lower class)."""
    p = posteriors(spark, sf)
    mlp = F.when(F.col("most_likely") == 1, F.col("post_1")).otherwise(F.col("post_2"))
    return p.select("subject", "most_likely", _r(mlp).alias("ml_posterior"))


@query("a8_class_counts", sql=SCORE_SQL + """
SELECT CAST(class AS INTEGER) AS class, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 4) AS proportion
FROM sc WHERE class = most_likely GROUP BY class""")
def a8_class_counts(spark, sf):
    """Class counts and proportions by most likely class."""
    c = S.class_counts(scores(spark, sf))
    return c.select(F.col("class").cast("int").alias("class"), "count", _r(F.col("proportion")).alias("proportion"))


@query("a9_class_mass", sql=SCORE_SQL + """
SELECT CAST(class AS INTEGER) AS class, round(sum(posterior), 4) AS count,
       round(sum(posterior) / sum(sum(posterior)) OVER (), 4) AS proportion
FROM sc GROUP BY class""")
def a9_class_mass(spark, sf):
    """Class counts and proportions by summed posterior probabilities."""
    c = S.class_mass(scores(spark, sf))
    return c.select(F.col("class").cast("int").alias("class"), _r(F.col("count")).alias("count"),
                    _r(F.col("proportion")).alias("proportion"))


@query("a10_entropy", sql=SCORE_SQL + f"""
SELECT CAST(count(DISTINCT subject) AS BIGINT) AS n,
       round(1.0 + sum(CASE WHEN posterior > 0 THEN posterior * ln(posterior) ELSE 0.0 END)
                   / (count(DISTINCT subject) * {math.log(K)!r}), 4) AS entropy
FROM sc""")
def a10_entropy(spark, sf):
    """Relative entropy of the classification."""
    e = S.entropy(scores(spark, sf), K)
    return e.select("n", _r(F.col("entropy")).alias("entropy"))


@query("a11_classification_table", sql=SCORE_SQL + """
SELECT CAST(class AS INTEGER) AS class,
       round(sum(CASE WHEN most_likely = 1 THEN posterior ELSE 0.0 END) / sum(posterior), 4) AS ml_1,
       round(sum(CASE WHEN most_likely = 2 THEN posterior ELSE 0.0 END) / sum(posterior), 4) AS ml_2
FROM sc GROUP BY class""")
def a11_classification_table(spark, sf):
    """Average posterior of each latent class (row) by most likely class (column)."""
    t = S.classification_table(scores(spark, sf), K)
    return t.select(F.col("class").cast("int").alias("class"), *[_r(F.col(f"ml_{h}")).alias(f"ml_{h}")
                                                                  for h in range(1, K + 1)])


@query("a12_classification_logits", sql=SCORE_SQL + """
SELECT CAST(class AS INTEGER) AS class,
       round(ln(sum(CASE WHEN most_likely = 1 THEN posterior ELSE 0.0 END)
                / sum(CASE WHEN most_likely = 2 THEN posterior ELSE 0.0 END)), 4) AS logit_1,
       0.0 AS logit_2
FROM sc GROUP BY class""")
def a12_classification_logits(spark, sf):
    """Logits of the classification table against the last class."""
    t = S.classification_logits(S.classification_table(scores(spark, sf), K), K)
    return t.select(F.col("class").cast("int").alias("class"), *[_r(F.col(f"logit_{h}")).alias(f"logit_{h}")
                                                                  for h in range(1, K + 1)])


FS_SQL = SCORE_SQL + """,
fs AS (
  SELECT sc.subject,
         sum(posterior * (c.a0 + b0)) AS i, sum(posterior * (c.a1 + b1)) AS s, sum(posterior * (c.a2 + b2)) AS q,
         max(CASE WHEN sc.class = most_likely THEN c.a0 + b0 END) AS c_i,
         max(CASE WHEN sc.class = most_likely THEN c.a1 + b1 END) AS c_s,
         max(CASE WHEN sc.class = most_likely THEN c.a2 + b2 END) AS c_q
  FROM sc JOIN params c ON c.class = sc.class GROUP BY sc.subject)
"""


@query("m9_factor_scores", sql=FS_SQL + """
SELECT subject, round(i, 4) + 0.0 AS i, round(s, 4) + 0.0 AS s, round(q, 4) + 0.0 AS q,
       round(c_i, 4) + 0.0 AS c_i, round(c_s, 4) + 0.0 AS c_s, round(c_q, 4) + 0.0 AS c_q FROM fs""")
def m9_factor_scores(spark, sf):
    """Posterior means of the growth factors, mixed over classes and at the most likely class."""
    f = S.factor_scores(posteriors(spark, sf), K)
    return f.select("subject", *[_r(F.col(c)).alias(c) for c in ["i", "s", "q", "c_i", "c_s", "c_q"]])


_FCOLS = ["i", "s", "q", "c_i", "c_s", "c_q"]


@query("a13_factor_moments", sql=FS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{r}' AS row, '{c}' AS col, round(avg({r}), 4) AS mean_row, round(covar_pop({r}, {c}), 4) AS covariance, "
    + ("round(CAST(1.0 AS DOUBLE), 4)" if r == c else f"round(corr({r}, {c}), 4)") + " AS correlation FROM fs"
    for i, r in enumerate(_FCOLS) for c in _FCOLS[:i + 1]))
def a13_factor_moments(spark, sf):
    """Means, population covariances and correlations of the factor scores."""
    m = S.factor_moments(S.factor_scores(posteriors(spark, sf), K))
    return m.select("row", "col", *[_r(F.col(c)).alias(c) for c in ["mean_row", "covariance", "correlation"]])


@query("m10_estimated_values", sql=FS_SQL + """
SELECT subject, CAST(w.wave AS INTEGER) AS wave, round(i + s * w.wave + q * w.wave * w.wave, 4) AS estimate
FROM fs CROSS JOIN (SELECT DISTINCT wave FROM panel_p) w""")
def m10_estimated_values(spark, sf):
    """Fitted value per subject and wave from the mixed factor scores."""
    W = waves_p(spark, sf)
    e = S.estimated_values(S.factor_scores(posteriors(spark, sf, W), K), range(W))
    return e.select("subject", F.col("wave").cast("int").alias("wave"), _r(F.col("estimate")).alias("estimate"))


@query("m13_attach_class", sql=SCORE_SQL + """
SELECT p.subject, p.wave, p.y, s.most_likely FROM panel_p p
LEFT JOIN (SELECT subject, most_likely FROM sc WHERE class = most_likely) s ON p.subject = s.subject""")
def m13_attach_class(spark, sf):
    """Most likely class joined back to the long panel by subject id."""
    a = S.attach_class(panel_p(spark, sf).select("subject", "wave", "y"), scores(spark, sf), GROUP)
    return a.select("subject", "wave", "y", "most_likely")


FLAGSHIP_SQL = SCORE_SQL + """,
mass AS (SELECT class, sum(posterior) / sum(sum(posterior)) OVER () AS share FROM sc GROUP BY class),
cnt AS (SELECT class, count(*) AS n_ml FROM sc WHERE class = most_likely GROUP BY class)
SELECT CAST(c.class AS INTEGER) AS class, CAST(w.wave AS INTEGER) AS wave,
       round(c.a0 + c.a1 * w.wave + c.a2 * w.wave * w.wave, 4) AS mean,
       round(m.share, 4) AS share, coalesce(n.n_ml, 0) AS count
FROM params c CROSS JOIN (SELECT DISTINCT wave FROM panel_p) w
LEFT JOIN mass m ON m.class = c.class LEFT JOIN cnt n ON n.class = c.class"""


@query("flagship_score_classes", sql=FLAGSHIP_SQL)
def flagship_score_classes(spark, sf):
    """Flagship: score panel P with a fixed two-class model; per class and wave the class
    curve, its posterior share and its most-likely count (M5 -> A8/A9 -> M11/M12)."""
    W = waves_p(spark, sf)
    summ = S.class_summary(posteriors(spark, sf, W), K)
    curves = S.estimated_means(flagship_params(spark, W), range(W))
    out = curves.join(summ, ["group", "class"], "left")
    return out.select(F.col("class").cast("int").alias("class"), F.col("wave").cast("int").alias("wave"),
                      _r(F.col("mean")).alias("mean"), _r(F.col("share")).alias("share"),
                      F.coalesce(F.col("n_most_likely"), F.lit(0)).cast("long").alias("count"))


@query("m12_trajectory_table", sql=FLAGSHIP_SQL.replace(", coalesce(n.n_ml, 0) AS count", ""))
def m12_trajectory_table(spark, sf):
    """Class curve with posterior class share per (class, wave)."""
    W = waves_p(spark, sf)
    traj = S.trajectory_table(flagship_params(spark, W), S.to_scores(posteriors(spark, sf, W), K), range(W), basis="posterior")
    return traj.select(F.col("class").cast("int").alias("class"), F.col("wave").cast("int").alias("wave"),
                       _r(F.col("mean")).alias("mean"), _r(F.col("share")).alias("share"))


@query("m13_m2_regression_on_class", sql=SCORE_SQL + """,
x AS (SELECT c.c_acctbal AS y, CAST(s.most_likely AS DOUBLE) AS x
      FROM customer c JOIN (SELECT subject, most_likely FROM sc WHERE class = most_likely) s ON s.subject = c.c_custkey),
b AS (SELECT count(*) AS n, regr_intercept(y, x) AS b0, regr_slope(y, x) AS b1, regr_sxx(y, x) AS sxx FROM x),
e AS (SELECT sum(power(y - b0 - b1 * x, 2)) AS rss FROM x, b)
SELECT n, round(b0, 4) + 0.0 AS beta_0, round(b1, 4) + 0.0 AS beta_1, round(sqrt(rss / (n - 2) / sxx), 4) AS se_1,
       round(b1 / sqrt(rss / (n - 2) / sxx), 4) + 0.0 AS t_1 FROM b, e""")
def m13_m2_regression_on_class(spark, sf):
    """Account balance regressed on the attached class of the customer."""
    from trajectra.operators import fit as FT
    from trajectra.plans.panels import table
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), "c_acctbal")
    a = S.attach_class(c, scores(spark, sf), GROUP).where(F.col("most_likely").isNotNull())
    o = FT.ols(a, "c_acctbal", ["most_likely"])
    return o.select("n", *[_r(F.col(x)).alias(x) for x in ["beta_0", "beta_1", "se_1", "t_1"]])

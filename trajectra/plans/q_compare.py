"""Registered queries: model comparison on growth fits of panel E.

Fits: maximum-likelihood polynomial growth curves (degree 0, 1, 2: nested) of
the event value on the visit number, one set per event type (outcome), with a
robust scaling factor from the residual fourth moment.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trajectra.functions import stats as ST
from trajectra.operators import compare as CM
from trajectra.operators import fit as FT
from trajectra.operators import panel as P
from trajectra.plans.panels import PANEL_E_SQL, panel_e, table, waves_e
from trajectra.plans.registry import query

LN2PI = math.log(2.0 * math.pi)
KEYS = ["outcome"]


def _r(c, d=4):
    return F.round(c, d) + F.lit(0.0)


def fits(spark, sf):
    pe = panel_e(spark, sf)
    f = FT.polynomial_fits(pe, KEYS)
    return FT.with_scaling(f, pe, KEYS)


# ----------------------------------------------------------------- SQL twins

def chi2_tail(x: str, df: str) -> str:
    """Upper chi-square tail for DuckDB: one minus the power series of the lower incomplete
    gamma function, term by term with DuckDB's lgamma."""
    h, a = f"(({x}) / 2.0)", f"(({df}) / 2.0)"
    return (f"(CASE WHEN ({x}) IS NULL OR ({df}) IS NULL OR ({df}) < 1 THEN NULL WHEN ({x}) <= 0 THEN 1.0 ELSE greatest(0.0, 1.0 - "
            f"list_sum(list_transform(range(0, 1000), lambda i: exp(-{h} + ({a} + i) * ln({h}) - lgamma({a} + i + 1))))) END)")


# Degrees 0, 1 and 2 by successive regressions: the square's residual on time (q) is
# orthogonal to time, so each coefficient is a ratio of two sums; residuals are then summed
# row by row.
FITS_SQL = "WITH" + PANEL_E_SQL + f""",
o AS (SELECT outcome, CAST(wave AS DOUBLE) AS t, y FROM panel_e WHERE y IS NOT NULL),
ln1 AS (SELECT outcome, count(*) AS n, avg(t) AS tm, avg(y) AS ym, regr_slope(t * t, t) AS bq, regr_intercept(t * t, t) AS aq,
             regr_slope(y, t) AS c1, regr_sxx(y, t) AS stt FROM o GROUP BY outcome),
q AS (SELECT o.outcome, o.t, o.y, o.t * o.t - ln1.aq - ln1.bq * o.t AS q FROM o JOIN ln1 ON o.outcome = ln1.outcome),
qd AS (SELECT outcome, sum(q * y) / sum(q * q) AS c2, sum(q * q) AS sqq FROM q GROUP BY outcome),
cf AS (SELECT ln1.outcome, d.degree, ln1.n, ln1.tm, ln1.stt, ln1.aq, ln1.bq, qd.sqq,
             CASE d.degree WHEN 0 THEN ym WHEN 1 THEN ym - c1 * tm ELSE ym - c1 * tm - c2 * aq END AS beta_0,
             CASE d.degree WHEN 0 THEN 0.0 WHEN 1 THEN c1 ELSE c1 - c2 * bq END AS beta_1,
             CASE d.degree WHEN 2 THEN c2 ELSE 0.0 END AS beta_2
      FROM ln1 JOIN qd ON ln1.outcome = qd.outcome CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS degree) d),
rs AS (SELECT cf.outcome, cf.degree, sum(power(o.y - cf.beta_0 - cf.beta_1 * o.t - cf.beta_2 * o.t * o.t, 2)) AS rss,
              avg(power(o.y - cf.beta_0 - cf.beta_1 * o.t - cf.beta_2 * o.t * o.t, 4)) AS m4
       FROM o JOIN cf ON o.outcome = cf.outcome GROUP BY cf.outcome, cf.degree),
fits AS (
  SELECT cf.outcome, cf.degree, cf.n, beta_0, beta_1, beta_2, rss / n AS sigma2, CAST(cf.degree + 2 AS INTEGER) AS parameters,
         -0.5 * n * (ln(2.0 * pi()) + ln(rss / n) + 1.0) AS ll,
         sqrt(rss / (n - cf.degree - 1) * (1.0 / n + CASE WHEN cf.degree > 0 THEN tm * tm / stt ELSE 0 END
                                          + CASE WHEN cf.degree > 1 THEN aq * aq / sqq ELSE 0 END)) AS se_0,
         CASE cf.degree WHEN 1 THEN sqrt(rss / (n - 2) / stt) WHEN 2 THEN sqrt(rss / (n - 3) * (1.0 / stt + bq * bq / sqq)) END AS se_1,
         CASE cf.degree WHEN 2 THEN sqrt(rss / (n - 3) / sqq) END AS se_2,
         (cf.degree + 1 + (m4 / power(rss / n, 2) - 1) / 2.0) / (cf.degree + 2) AS scaling
  FROM cf JOIN rs ON cf.outcome = rs.outcome AND cf.degree = rs.degree)
"""


@query("m2_polynomial_fits", sql=FITS_SQL + """
SELECT outcome, degree, n, round(beta_0, 4) + 0.0 AS beta_0, round(beta_1, 4) + 0.0 AS beta_1,
       round(beta_2, 4) + 0.0 AS beta_2, round(se_0, 4) AS se_0, round(se_1, 4) AS se_1, round(se_2, 4) AS se_2,
       round(sigma2, 4) AS sigma2, round(ll, 4) AS ll, parameters, round(scaling, 4) AS scaling FROM fits""")
def m2_polynomial_fits(spark, sf):
    """Least-squares / ML growth polynomials per outcome (normal equations as one aggregate)."""
    f = fits(spark, sf)
    return f.select("outcome", F.col("degree").cast("int").alias("degree"), "n",
                    *[_r(F.col(c)).alias(c) for c in ["beta_0", "beta_1", "beta_2", "se_0", "se_1", "se_2", "sigma2", "ll"]],
                    "parameters", _r(F.col("scaling")).alias("scaling"))


@query("m2_ols_regression", sql="""
WITH x AS (SELECT c_nationkey AS k, c_acctbal AS y, CAST(c_custkey % 100 AS DOUBLE) AS x FROM customer),
s AS (SELECT k, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, avg(x) AS xm FROM x GROUP BY k),
e AS (SELECT x.k, sum(power(y - b0 - b1 * x, 2)) AS rss FROM x JOIN s ON x.k = s.k GROUP BY x.k)
SELECT s.k AS c_nationkey, n, round(b0, 4) + 0.0 AS beta_0, round(b1, 4) + 0.0 AS beta_1, round(rss / n, 4) AS sigma2,
       round(sqrt(rss / (n - 2) * (1.0 / n + xm * xm / sxx)), 4) AS se_0, round(sqrt(rss / (n - 2) / sxx), 4) AS se_1,
       round(b1 / sqrt(rss / (n - 2) / sxx), 4) + 0.0 AS t_1
FROM s JOIN e ON s.k = e.k WHERE n > 2""")
def m2_ols_regression(spark, sf):
    """Regression of account balance on a customer covariate, per nation."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", (F.col("c_custkey") % 100).cast("double").alias("x1"))
    o = FT.ols(c, "c_acctbal", ["x1"], ["c_nationkey"]).where(F.col("n") > 2)
    return o.select("c_nationkey", "n", *[_r(F.col(x)).alias(x) for x in ["beta_0", "beta_1", "sigma2", "se_0", "se_1", "t_1"]])


@query("m2_ols_three_regressors", sql="""
WITH x AS (SELECT l_returnflag AS k, l_extendedprice AS y, [l_quantity, l_discount, l_tax] AS v FROM lineitem),
m AS (SELECT k, avg(y) AS ym, avg(v[1]) AS m1, avg(v[2]) AS m2, avg(v[3]) AS m3 FROM x GROUP BY k),
-- Gram-Schmidt: each regressor less its projection on those before it
a AS (SELECT x.k, y, v[1] - m1 AS u1, v[2] - m2 AS c2, v[3] - m3 AS c3 FROM x JOIN m ON x.k = m.k),
p1 AS (SELECT k, sum(u1 * c2) / sum(u1 * u1) AS r12, sum(u1 * c3) / sum(u1 * u1) AS r13, sum(u1 * y) / sum(u1 * u1) AS g1 FROM a GROUP BY k),
b AS (SELECT a.k, y, u1, c2 - r12 * u1 AS u2, c3 - r13 * u1 AS d3 FROM a JOIN p1 ON a.k = p1.k),
p2 AS (SELECT k, sum(u2 * d3) / sum(u2 * u2) AS r23, sum(u2 * y) / sum(u2 * u2) AS g2 FROM b GROUP BY k),
c AS (SELECT b.k, y, d3 - r23 * u2 AS u3 FROM b JOIN p2 ON b.k = p2.k),
p3 AS (SELECT k, sum(u3 * y) / sum(u3 * u3) AS g3, count(*) AS n FROM c GROUP BY k),
z AS (SELECT p3.k, n, g3 AS b3, g2 - r23 * g3 AS b2, g1 - r12 * (g2 - r23 * g3) - r13 * g3 AS b1
      FROM p1 JOIN p2 ON p1.k = p2.k JOIN p3 ON p1.k = p3.k)
SELECT z.k AS l_returnflag, n, round(ym - b1 * m1 - b2 * m2 - b3 * m3, 3) + 0.0 AS beta_0, round(b1, 3) + 0.0 AS beta_1,
       round(b2, 3) + 0.0 AS beta_2, round(b3, 3) + 0.0 AS beta_3 FROM z JOIN m ON z.k = m.k""")
def m2_ols_three_regressors(spark, sf):
    """Regression of a line's price on quantity, discount and tax, per return flag."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    o = FT.ols(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return o.select("l_returnflag", "n", *[_r(F.col(f"beta_{a}"), 3).alias(f"beta_{a}") for a in range(4)])


@query("m1_subject_slopes", sql="""
WITH""" + PANEL_E_SQL + """
SELECT subject, outcome, CAST(regr_count(y, wave) AS BIGINT) AS n, round(regr_intercept(y, wave), 8) + 0.0 AS intercept,
       round(regr_slope(y, wave), 8) + 0.0 AS slope
FROM panel_e GROUP BY subject, outcome""")
def m1_subject_slopes(spark, sf):
    """Per-subject least-squares line of the event value on the visit number."""
    s = FT.subject_slopes(panel_e(spark, sf).withColumn("sk", F.struct("subject", "outcome")), "sk")
    return s.select("sk.subject", "sk.outcome", "n", _r(F.col("intercept"), 8).alias("intercept"),
                    _r(F.col("slope"), 8).alias("slope"))


@query("c1_c3_information_criteria", sql=FITS_SQL + """
SELECT outcome, degree, round(-2.0 * ll, 4) AS deviance, round(-2.0 * ll + 2.0 * parameters, 4) AS aic,
       round(-2.0 * ll + parameters * ln(n), 4) AS bic,
       round(-2.0 * ll + parameters * ln((n + 2.0) / 24.0), 4) AS abic,
       round(-2.0 * ll + 2.0 * parameters + 2.0 * parameters * (parameters + 1.0) / (n - parameters - 1.0), 4) AS aicc
FROM fits""")
def c1_c3_information_criteria(spark, sf):
    """Deviance, AIC, BIC, adjusted BIC and AICc of every fit."""
    f = CM.with_information_criteria(fits(spark, sf))
    return f.select("outcome", F.col("degree").cast("int").alias("degree"),
                    *[_r(F.col(c)).alias(c) for c in ["deviance", "aic", "bic", "abic", "aicc"]])


@query("c4_w4_lr_test", sql=FITS_SQL + f"""
, t AS (SELECT outcome, degree, -2.0 * ll AS deviance,
              lag(-2.0 * ll) OVER (PARTITION BY outcome ORDER BY degree) - (-2.0 * ll) AS chisq,
              parameters - lag(parameters) OVER (PARTITION BY outcome ORDER BY degree) AS dif_df FROM fits)
SELECT outcome, degree, round(deviance, 4) AS deviance, round(chisq, 4) AS chisq, dif_df,
       round({chi2_tail('chisq', 'dif_df')}, 5) AS p_value FROM t""")
def c4_w4_lr_test(spark, sf):
    """Likelihood-ratio test of each growth degree against the previous (lag within outcome)."""
    t = CM.lr_test(fits(spark, sf), KEYS, ["degree"])
    return t.select("outcome", F.col("degree").cast("int").alias("degree"), _r(F.col("deviance")).alias("deviance"),
                    _r(F.col("chisq")).alias("chisq"), "dif_df", F.round("p_value", 5).alias("p_value"))


@query("c5_w5_scaled_lr_test", sql=FITS_SQL + f"""
, l AS (SELECT *, lag(parameters) OVER w AS p0, lag(scaling) OVER w AS c0, lag(ll) OVER w AS l0
        FROM fits WINDOW w AS (PARTITION BY outcome ORDER BY degree)),
c AS (SELECT *, (p0 * c0 - parameters * scaling) / (p0 - parameters) AS cd FROM l),
t AS (SELECT *, abs(-2.0 * (l0 - ll) / cd) AS trd, parameters - p0 AS dif_df_trd FROM c)
SELECT outcome, degree, round(cd, 4) + 0.0 AS cd, cd < 0 AS cd_negative, round(trd, 4) AS trd, dif_df_trd,
       round({chi2_tail('trd', 'dif_df_trd')}, 5) AS p_trd FROM t""")
def c5_w5_scaled_lr_test(spark, sf):
    """Scaled likelihood-ratio test with the robust scaling factors (lag of two columns)."""
    t = CM.scaled_lr_test(fits(spark, sf), KEYS, ["degree"])
    return t.select("outcome", F.col("degree").cast("int").alias("degree"), _r(F.col("cd")).alias("cd"),
                    "cd_negative", _r(F.col("trd")).alias("trd"), "dif_df_trd", F.round("p_trd", 5).alias("p_trd"))


@query("c6_chi2_upper", sql=f"""
WITH e AS (SELECT event_id, value * (1 + event_id % 3) AS x, CAST(1 + event_id % 200 AS INTEGER) AS df FROM events)
SELECT event_id, df, round({chi2_tail('x', 'df')}, 6) AS p FROM e""")
def c6_chi2_upper(spark, sf):
    """Chi-square upper tail for every event value with df 1..200."""
    e = table(spark, sf, "events").select("event_id", (F.col("value") * (1 + F.col("event_id") % 3)).alias("x"),
                                          (1 + F.col("event_id") % 200).cast("int").alias("df"))
    return e.select("event_id", "df", F.round(ST.chi2_upper("x", "df"), 6).alias("p"))


@query("c7_wald", sql=FITS_SQL + f"""
SELECT outcome, degree, round(beta_1 / se_1, 4) + 0.0 AS z,
       round({chi2_tail('power(beta_1 / se_1, 2)', '1')}, 5) AS p FROM fits WHERE degree >= 1""")
def c7_wald(spark, sf):
    """z and two-sided p of the linear growth coefficient."""
    f = fits(spark, sf).where(F.col("degree") >= 1)
    z, p = ST.wald("beta_1", "se_1")
    return f.select("outcome", F.col("degree").cast("int").alias("degree"), _r(z).alias("z"), F.round(p, 5).alias("p"))


@query("c8_c10_step_compare", sql=FITS_SQL + f"""
, j AS (SELECT a.outcome, a.degree, a.n, 2.0 * (a.ll - b.ll) AS lrt, a.parameters - b.parameters AS dp
        FROM fits a LEFT JOIN fits b ON a.outcome = b.outcome AND a.degree = b.degree + 1)
SELECT outcome, degree, round(lrt, 4) AS lrt, dp, round(lrt * dp * ln(n) / (dp * ln(n) + 1.0), 4) AS lrt_adjusted
FROM j""")
def c8_c10_step_compare(spark, sf):
    """Each fit against the one a step below (self equi-join), with the adjusted statistic."""
    t = CM.step_compare(fits(spark, sf), KEYS, step="degree")
    return t.select("outcome", F.col("degree").cast("int").alias("degree"), _r(F.col("lrt")).alias("lrt"), "dp",
                    _r(F.col("lrt_adjusted")).alias("lrt_adjusted"))


@query("c9_class_share", sql="""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
l AS (SELECT event_type, ln(n) - ln(first_value(n) OVER (ORDER BY event_type DESC)) AS logit FROM c)
SELECT event_type, round(logit, 4) + 0.0 AS logit, round(exp(logit) / sum(exp(logit)) OVER (), 4) AS share FROM l""")
def c9_class_share(spark, sf):
    """Shares from logits against the last category (softmax), on event-type counts."""
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    last = c.agg(F.max_by("n", "event_type").alias("__ref"))           # one row
    lg = c.crossJoin(F.broadcast(last)).withColumn("logit", F.log(F.col("n")) - F.log(F.col("__ref")))
    s = CM.class_share(lg.withColumn("model", F.lit("events")), ["model"])
    return s.select("event_type", _r(F.col("logit")).alias("logit"), _r(F.col("share")).alias("share"))


@query("m15_compare_nested", sql=FITS_SQL + f"""
, j AS (SELECT a.outcome, 2.0 * (b.ll - a.ll) AS chisq, b.parameters - a.parameters AS dif_df
        FROM fits a JOIN fits b ON a.outcome = b.outcome AND a.degree = 0 AND b.degree = 2)
SELECT outcome, round(chisq, 4) AS chisq, dif_df, round({chi2_tail('chisq', 'dif_df')}, 5) AS p_value FROM j""")
def m15_compare_nested(spark, sf):
    """Means model against the quadratic model, per outcome."""
    f = fits(spark, sf)
    j = CM.compare_nested(f.where(F.col("degree") == 0), f.where(F.col("degree") == 2), KEYS)
    return j.select("outcome", _r(F.col("chisq")).alias("chisq"), "dif_df", F.round("p_value", 5).alias("p_value"))


@query("v2_facts_to_rows", sql=FITS_SQL + """
, facts AS (
  SELECT outcome || '-' || degree AS model_id, name, value FROM (
    SELECT outcome, degree, 'LL' AS name, CAST(round(ll, 3) AS VARCHAR) AS value FROM fits UNION ALL
    SELECT outcome, degree, 'Parameters', CAST(parameters AS VARCHAR) FROM fits UNION ALL
    SELECT outcome, degree, 'Observations', CAST(n AS VARCHAR) FROM fits UNION ALL
    SELECT outcome, degree, 'Title', 'polynomial growth' FROM fits) u)
SELECT model_id, TRY_CAST(max(CASE WHEN name = 'LL' THEN value END) AS DOUBLE) AS LL,
       TRY_CAST(max(CASE WHEN name = 'Parameters' THEN value END) AS INTEGER) AS Parameters,
       TRY_CAST(max(CASE WHEN name = 'Observations' THEN value END) AS BIGINT) AS Observations
FROM facts GROUP BY model_id""")
def v2_facts_to_rows(spark, sf):
    """Long (model, name, text value) facts back to one typed row per model (pivot with a target list)."""
    f = fits(spark, sf).select(F.concat_ws("-", "outcome", F.col("degree").cast("string")).alias("model_id"),
                               "ll", "parameters", "n")
    facts = f.selectExpr("model_id", "stack(4, 'LL', CAST(round(ll, 3) AS STRING), "
                         "'Parameters', CAST(parameters AS STRING), 'Observations', CAST(n AS STRING), "
                         "'Title', 'polynomial growth') AS (name, value)")
    wide = P.facts_to_rows(facts, "model_id", "name", "value", ["LL", "Parameters", "Observations"])
    return P.cast_numeric(P.cast_numeric(P.cast_numeric(wide, ["LL"]), ["Parameters"], "int"), ["Observations"], "long")


@query("w8_rank_starts", sql="""
WITH""" + PANEL_E_SQL + """,
s AS (SELECT outcome, subject, round(-0.5 * sum(ln(2.0 * pi()) + 2.0 * ln(y + 1.0)), 3) AS ll
      FROM panel_e WHERE y IS NOT NULL GROUP BY outcome, subject),
b AS (SELECT *, max(ll) OVER (PARTITION BY outcome) AS best FROM s),
r AS (SELECT *, rank() OVER (PARTITION BY outcome ORDER BY ll DESC) AS rank,
             sum(CASE WHEN ll = best THEN 1 ELSE 0 END) OVER (PARTITION BY outcome) AS n_best
      FROM b)
SELECT outcome, subject, ll, CAST(rank AS INTEGER) AS rank, CAST(n_best AS BIGINT) AS n_best, n_best >= 2 AS best_replicated FROM r""")
def w8_rank_starts(spark, sf):
    """Rank candidate solutions (one per subject here) by log-likelihood; flag a replicated best."""
    pe = panel_e(spark, sf).where(F.col("y").isNotNull())
    s = pe.groupBy("outcome", "subject").agg(
        (F.lit(-0.5) * F.sum(F.lit(math.log(2.0 * math.pi)) + 2.0 * F.log(F.col("y") + 1.0))).alias("ll"))
    r = CM.rank_starts(s, ["outcome"], "ll", 3)
    return r.select("outcome", "subject", F.col("ll_rounded").alias("ll"), F.col("rank").cast("int").alias("rank"),
                    F.col("n_best").cast("long").alias("n_best"), "best_replicated")


@query("m14_fit_table", sql=FITS_SQL + f"""
, t AS (SELECT *, lag(-2.0 * ll) OVER (PARTITION BY outcome ORDER BY degree) - (-2.0 * ll) AS chisq,
              parameters - lag(parameters) OVER (PARTITION BY outcome ORDER BY degree) AS dif_df FROM fits),
curve AS (SELECT f.outcome, f.degree,
                 string_agg(CAST(round(f.beta_0 + f.beta_1 * w.wave + f.beta_2 * w.wave * w.wave, 2) AS VARCHAR), ','
                            ORDER BY w.wave) AS curve
          FROM fits f CROSS JOIN (SELECT DISTINCT wave FROM panel_e) w GROUP BY f.outcome, f.degree)
SELECT t.outcome || '-' || t.degree AS model_id, t.parameters, round(t.ll, 3) AS ll,
       round(-2.0 * t.ll + 2.0 * t.parameters, 3) AS aic, round(-2.0 * t.ll + t.parameters * ln(t.n), 3) AS bic,
       round(t.chisq, 3) AS chisq, t.dif_df, round({chi2_tail('t.chisq', 't.dif_df')}, 5) AS p_value, c.curve
FROM t JOIN curve c ON c.outcome = t.outcome AND c.degree = t.degree""")
def m14_fit_table(spark, sf):
    """One row per model: fit statistics, LR test against the previous model and the fitted curve as text."""
    f = CM.with_information_criteria(fits(spark, sf))
    f = CM.lr_test(f, KEYS, ["degree"])
    pts = f.select("outcome", "degree", F.explode(F.sequence(F.lit(0), F.lit(waves_e(spark, sf) - 1))).alias("wave"),
                   "beta_0", "beta_1", "beta_2")
    pts = pts.withColumn("v", F.round(F.col("beta_0") + F.col("beta_1") * F.col("wave")
                                      + F.col("beta_2") * F.col("wave") * F.col("wave"), 2).cast("string"))
    curve = CM.collapse_text(pts, ["outcome", "degree"], "v", "wave", ",", "curve")
    t = CM.fit_table(f, ["outcome", "degree"], class_text=curve)
    return t.select(F.concat_ws("-", "outcome", F.col("degree").cast("string")).alias("model_id"), "parameters",
                    F.round("ll", 3).alias("ll"), F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"),
                    F.round("chisq", 3).alias("chisq"), "dif_df",
                    F.round(ST.chi2_upper("chisq", "dif_df"), 5).alias("p_value"), "curve")

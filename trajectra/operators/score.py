"""Scoring subjects into latent trajectory classes.

A long panel (subject, wave, y) meets a parameter table with one row per *group*
(a model, or a start of a model) that carries every class's parameters: means and
random-effect covariances as suffixed columns (``a0_1, p00_1, lnpi_1, ...``),
residual variances as one array per class.  The visits of a subject are summed to
a handful of numbers per class in one map-side combined aggregate, whatever the
number of waves; likelihoods, posteriors and random-effect posteriors are then
column expressions of the subject's one row.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions import mixed as X
from trajectra.session import stage

MAX_PARAM_ROWS = 100_000     # parameter tables are broadcast up to this many rows (groups)


def sfx(k: int):
    return lambda s: f"{s}_{k}"


SCALARS = ["a0", "a1", "a2"] + [f"p{a}{b}" for a, b in X.IDX] + ["lnpi"]


def widen_params(params: DataFrame, K: int, W: int, group: str = "group") -> DataFrame:
    """Long parameters (group, class, a0.., th_t.., p.., lnpi) -> one row per group, th_k an array over waves."""
    th = params.select("*", F.array(*[F.col(f"th_{t}").cast("double") for t in range(W)]).alias("__th"))
    aggs = [F.max(F.when(F.col("class") == k, F.col(c).cast("double"))).alias(f"{c}_{k}")
            for k in range(1, K + 1) for c in SCALARS]
    aggs += [F.max(F.when(F.col("class") == k, F.col("__th"))).alias(f"th_{k}") for k in range(1, K + 1)]
    return th.groupBy(group).agg(*aggs)


def expand_classes(panel: DataFrame, params_wide: DataFrame) -> DataFrame:
    """Every visit meets every group's parameters.

    The parameter side is bounded by models x starts; it is broadcast in blocks of
    about ``MAX_PARAM_ROWS`` groups, each of which meets the panel once.
    """
    params_wide = stage(params_wide, "parameters")
    blocks = max(1, -(-params_wide.count() // max(1, MAX_PARAM_ROWS)))
    if blocks == 1:
        return panel.crossJoin(F.broadcast(params_wide))
    block = F.pmod(F.xxhash64(*params_wide.columns[:1]), F.lit(blocks))
    return reduce(DataFrame.unionByName, [panel.crossJoin(F.broadcast(params_wide.where(block == i))) for i in range(blocks)])


def n_classes(params: DataFrame) -> int:
    return int(params.agg(F.max("class")).first()[0])


def panel_posteriors(panel: DataFrame, params: DataFrame, W: int, times: Sequence[float] | None = None,
                     K: int | None = None, subject: str = "subject", wave: str = "wave", y: str = "y",
                     group: str = "group") -> DataFrame:
    """M5 core on a long panel: one row per (subject, group) with, for each class k,
    logf_k, b0_k..b2_k, D.._k, posterior post_k, and ll (the subject's mixture
    log-likelihood) and most_likely (W7: argmax, ties to the lowest class).

    ``params`` is long: (group, class, a0.., th_0..th_{W-1}, p.., lnpi).
    """
    K = K or n_classes(params)
    times = [float(t) for t in times] if times is not None else [float(t) for t in range(W)]
    x = panel.select(subject, F.col(wave).alias("__w"), F.col(y).cast("double").alias("__y"),
                     F.element_at(F.array(*[F.lit(t) for t in times]), F.col(wave) + 1).alias("__t"))
    x = expand_classes(x, widen_params(params, K, W, group))
    x = x.withColumns({f"__th_{k}": F.element_at(f"th_{k}", F.col("__w") + 1) for k in range(1, K + 1)})
    sums = {}
    for k in range(1, K + 1):
        sums.update(X.visit_stats("__y", "__t", f"__th_{k}", sfx(k)))
    x = x.groupBy(subject, group).agg(*[F.expr(v).alias(c) for c, v in sums.items()],
                                      *[F.first(f"{c}_{k}").alias(f"{c}_{k}") for k in range(1, K + 1) for c in SCALARS])
    return posterior_columns(x, K)


def class_posteriors(wide: DataFrame, params: DataFrame, ycols: Sequence[str],
                     times: Sequence[float] | None = None, K: int | None = None,
                     subject: str = "subject", group: str = "group") -> DataFrame:
    """``panel_posteriors`` on a wide panel; a subject without any value keeps a row."""
    long = wide.select(subject, F.posexplode(F.array(*[F.col(c).cast("double") for c in ycols])).alias("wave", "y"))
    return panel_posteriors(long, params, len(ycols), times, K, subject, "wave", "y", group)


def posterior_columns(x: DataFrame, K: int) -> DataFrame:
    """Add the closed-form E-step columns to rows with each class's sums and parameters.

    Each algebra stage is one struct for all classes, unpacked by ``inline``: every
    term is computed once, and as generated columns carry no equalities with the
    expressions behind them, the optimizer has none of them to propagate.
    """
    stages: list[dict[str, str]] = []
    for k in range(1, K + 1):
        for i, stage in enumerate(X.solve_stages(sfx(k))):
            if len(stages) <= i:
                stages.append({})
            stages[i].update(stage)
    ks = range(1, K + 1)
    stages.append({f"lp_{k}": f"(logf_{k} + lnpi_{k})" for k in ks})
    stages.append({"__top": "lp_1" if K == 1 else "greatest(" + ", ".join(f"lp_{k}" for k in ks) + ")"})
    stages.append({"ll": "(__top + ln(" + " + ".join(f"exp(lp_{k} - __top)" for k in ks) + "))"})
    stages.append({**{f"post_{k}": f"exp(lp_{k} - ll)" for k in ks},
                   "most_likely": "CAST(CASE " + " ".join(f"WHEN lp_{k} = __top THEN {k}" for k in ks) + " END AS INT)"})
    for stage in stages:
        x = x.selectExpr("*", "inline(array(named_struct(" + ", ".join(f"'{c}', {e}" for c, e in stage.items()) + ")))")
    return x.drop("__top", *[h for k in ks for h in X.helper_columns(sfx(k))])


def to_scores(post: DataFrame, K: int, subject: str = "subject", group: str = "group",
              extra: Sequence[str] = ()) -> DataFrame:
    """Stack the per-class columns to one row per (subject, group, class) (narrow)."""
    per = ["post", "logf", "b0", "b1", "b2", "a0", "a1", "a2"]
    parts = ", ".join(f"{k}, " + ", ".join(f"{c}_{k}" for c in per) for k in range(1, K + 1))
    names = ", ".join(["class"] + [("posterior" if c == "post" else c) for c in per])
    return post.selectExpr(subject, group, "ll", "most_likely", *extra,
                           f"stack({K}, {parts}) AS ({names})")


def score(wide: DataFrame, params: DataFrame, ycols: Sequence[str], times=None, K: int | None = None,
          subject: str = "subject", group: str = "group") -> DataFrame:
    """M5: scores(subject, group, class, posterior, most_likely, ll, logf, b*, a*)."""
    K = K or n_classes(params)
    return to_scores(class_posteriors(wide, params, ycols, times, K, subject, group), K, subject, group)


# ----------------------------------------------------------------- A8-A12

def class_counts(scores: DataFrame, group: str = "group") -> DataFrame:
    """Counts and proportions by most likely class (classes with no subject are absent)."""
    c = (scores.where(F.col("class") == F.col("most_likely"))
         .groupBy(group, "class").agg(F.count(F.lit(1)).alias("count")))
    return c.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(group)))


def class_mass(scores: DataFrame, group: str = "group") -> DataFrame:
    """Counts and proportions by summed posterior probabilities."""
    c = scores.groupBy(group, "class").agg(F.sum("posterior").alias("count"))
    return c.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy(group)))


def class_summary(post: DataFrame, K: int, group: str = "group") -> DataFrame:
    """A8 + A9 in one pass: per (group, class) the most-likely count, the posterior
    mass and both proportions, from the one-row-per-subject posterior frame
    (a single partial aggregate; no stacking of subjects)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for k in range(1, K + 1):
        aggs += [F.sum(F.when(F.col("most_likely") == k, 1).otherwise(0)).alias(f"__c_{k}"),
                 F.sum(F.col(f"post_{k}")).alias(f"__m_{k}")]
    t = post.groupBy(group).agg(*aggs)
    st = ", ".join(f"{k}, __c_{k}, __m_{k}" for k in range(1, K + 1))
    out = t.selectExpr(group, "__n", f"stack({K}, {st}) AS (class, n_most_likely, posterior_mass)")
    return out.select(group, F.col("class").cast("int").alias("class"),
                      F.col("n_most_likely").cast("long").alias("n_most_likely"), "posterior_mass",
                      (F.col("n_most_likely") / F.col("__n")).alias("ml_proportion"),
                      (F.col("posterior_mass") / F.col("__n")).alias("share"))


def entropy(scores: DataFrame, K: int, group: str = "group") -> DataFrame:
    """A10: relative entropy 1 + sum p ln p / (N ln K) per group (NULL when K = 1)."""
    plnp = F.when(F.col("posterior") > 0, F.col("posterior") * F.log(F.col("posterior"))).otherwise(0.0)
    agg = scores.groupBy(group).agg(F.sum(plnp).alias("__s"),
                                    F.sum(F.when(F.col("class") == 1, 1).otherwise(0)).alias("n"))
    val = (F.lit(1.0) + F.col("__s") / (F.col("n") * F.lit(math.log(K)))) if K > 1 else F.lit(None).cast("double")
    return agg.select(group, F.col("n").cast("long").alias("n"), val.alias("entropy"))


def classification_table(scores: DataFrame, K: int, group: str = "group") -> DataFrame:
    """q[k][h] = sum_j p_jk [most likely_j = h] / sum_j p_jk.

    Rows: latent class k; columns ml_1..ml_K: most likely class h (the report's
    'Classification Probabilities for the Most Likely Latent Class Membership
    (Column) by Latent Class (Row)').  The pivot values are given, so the schema
    is fixed; empty cells are 0.
    """
    agg = [F.sum(F.when(F.col("most_likely") == h, F.col("posterior")).otherwise(0.0)).alias(f"ml_{h}")
           for h in range(1, K + 1)]
    t = scores.groupBy(group, "class").agg(F.sum("posterior").alias("__row"), *agg)
    return t.select(group, "class", *[(F.col(f"ml_{h}") / F.col("__row")).alias(f"ml_{h}")
                                      for h in range(1, K + 1)])


def classification_logits(table: DataFrame, K: int, group: str = "group") -> DataFrame:
    """ln(q[k][h] / q[k][K])."""
    return table.select(group, "class", *[F.log(F.col(f"ml_{h}") / F.col(f"ml_{K}")).alias(f"logit_{h}")
                                          for h in range(1, K + 1)])


# ----------------------------------------------------------------- M9-M13, A13

FACTORS = ["i", "s", "q"]


def factor_scores(post: DataFrame, K: int, subject: str = "subject", group: str = "group") -> DataFrame:
    """M9: posterior means of i, s, q: mixed over classes, and at the most likely class (c_*)."""
    cols = []
    for a, f in enumerate(FACTORS):
        cols.append(sum((F.col(f"post_{k}") * (F.col(f"a{a}_{k}") + F.col(f"b{a}_{k}"))
                         for k in range(1, K + 1)), F.lit(0.0)).alias(f))
    for a, f in enumerate(FACTORS):
        e = None
        for k in range(1, K + 1):
            v = F.col(f"a{a}_{k}") + F.col(f"b{a}_{k}")
            e = F.when(F.col("most_likely") == k, v) if e is None else e.when(F.col("most_likely") == k, v)
        cols.append(e.alias(f"c_{f}"))
    return post.select(subject, group, "most_likely", *cols)


def factor_moments(fs: DataFrame, cols: Sequence[str] = ("i", "s", "q", "c_i", "c_s", "c_q"),
                   group: str = "group") -> DataFrame:
    """Means, population covariances and correlations of factor scores, long form
    (group, row, col, mean_row, covariance, correlation) for row >= col."""
    aggs = [F.avg(c).alias(f"__m_{c}") for c in cols]
    pairs = [(r, c) for i, r in enumerate(cols) for c in cols[:i + 1]]
    aggs += [F.covar_pop(r, c).alias(f"__v_{r}_{c}") for r, c in pairs]
    aggs += [F.corr(r, c).alias(f"__r_{r}_{c}") for r, c in pairs]
    t = fs.groupBy(group).agg(*aggs)
    stack = ", ".join(f"'{r}', '{c}', __m_{r}, __v_{r}_{c}, "
                      + ("CAST(1.0 AS DOUBLE)" if r == c else f"__r_{r}_{c}") for r, c in pairs)
    return t.selectExpr(group, f"stack({len(pairs)}, {stack}) AS (row, col, mean_row, covariance, correlation)")


def estimated_values(fs: DataFrame, times: Sequence[float], prefix: str = "",
                     subject: str = "subject", group: str = "group") -> DataFrame:
    """Fitted value per subject and wave from factor scores: i + s t + q t^2."""
    times = list(times)
    stack = ", ".join(f"{w}, {prefix}i + {prefix}s * {float(t)!r} + {prefix}q * {float(t) * float(t)!r}"
                      for w, t in enumerate(times))
    return fs.selectExpr(subject, group, f"stack({len(times)}, {stack}) AS (wave, estimate)")


def estimated_means(params: DataFrame, times: Sequence[float], group: str = "group") -> DataFrame:
    """Class curve a0 + a1 t + a2 t^2 per (group, class, wave) from a long parameter table."""
    times = list(times)
    stack = ", ".join(f"{w}, a0 + a1 * {float(t)!r} + a2 * {float(t) * float(t)!r}" for w, t in enumerate(times))
    return params.selectExpr(group, "class", f"stack({len(times)}, {stack}) AS (wave, mean)")


def trajectory_table(params: DataFrame, scores: DataFrame, times: Sequence[float],
                     group: str = "group", basis: str = "posterior") -> DataFrame:
    """Class curve with the class share, per (group, class, wave)."""
    shares = (class_mass(scores, group) if basis == "posterior" else class_counts(scores, group))
    curves = estimated_means(params, times, group)
    return curves.join(shares.select(group, "class", F.col("proportion").alias("share")),
                       [group, "class"], "left")


def attach_class(df: DataFrame, scores: DataFrame, model=None, subject: str = "subject",
                 group: str = "group") -> DataFrame:
    """Most likely class back to any table keyed by subject (left join on the id).

    ``model`` names the group to take.  Without it the scores must be of one model:
    a subject with several is an error when the result is computed, as rows would
    fan out.
    """
    ml = scores.where(F.col("class") == F.col("most_likely"))
    if model is not None:
        ml = ml.where(F.col(group) == model)
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("several models score a subject: name one"))).otherwise(F.lit(True))
    ml = ml.groupBy(subject).agg(F.first(group).alias(group), F.first("class").alias("most_likely"),
                                 F.first("posterior").alias("ml_posterior"), one.alias("__one"))
    return df.join(ml.where("__one").drop("__one"), subject, "left")

"""Comparison of fitted models.

A *fits* table has one row per model with at least: keys that group nested
models, an order column, ``ll``, ``parameters`` and (for scaled tests)
``scaling``.  Tests between consecutive models are ``lag`` windows over the
grouping keys; the groups are small (models per outcome), and the table itself is
bounded by the number of models, never by the data.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectra.functions import stats as ST
from trajectra.operators.panel import dense_index

PER_PART = 100_000          # distinct values whose counts one task adds up


def with_information_criteria(fits: DataFrame, ll: str = "ll", p: str = "parameters",
                              n: str = "n") -> DataFrame:
    """Deviance, AIC, BIC, sample-size adjusted BIC, AICc."""
    return fits.withColumns({
        "deviance": ST.deviance(ll), "aic": ST.aic(ll, p), "bic": ST.bic(ll, p, n),
        "abic": ST.abic(ll, p, n), "aicc": ST.aicc(ll, p, n)})


def lag_difference(fits: DataFrame, keys: Sequence[str], order: Sequence[str],
                   cols: Sequence[str], prefix: str = "d_") -> DataFrame:
    """Difference to the previous row within the group (NULL for the first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return fits.withColumns({f"{prefix}{c}": F.col(c) - F.lag(c).over(w) for c in cols})


def lr_test(fits: DataFrame, keys: Sequence[str], order: Sequence[str], ll: str = "ll",
            p: str = "parameters", digits: int = 5) -> DataFrame:
    """C4: likelihood-ratio test of each model against the previous one in its group.

    chisq = deviance(prev) - deviance, dif_df = p - p(prev), p_value = upper tail.
    """
    out = lag_difference(fits.withColumn("deviance", ST.deviance(ll)), keys, order, ["deviance", p], "__d_")
    out = out.withColumns({"chisq": -F.col("__d_deviance"), "dif_df": F.col(f"__d_{p}")}).drop("__d_deviance", f"__d_{p}")
    return out.withColumn("p_value", F.round(ST.chi2_upper("chisq", "dif_df"), digits))


def scaled_lr_test(fits: DataFrame, keys: Sequence[str], order: Sequence[str], ll: str = "ll",
                   p: str = "parameters", c: str = "scaling", digits: int = 5) -> DataFrame:
    """C5 + W5: scaled (robust) likelihood-ratio test against the previous model.

    cd = (p0 c0 - p1 c1) / (p0 - p1);  T = -2 (L0 - L1) / cd;  df = p1 - p0.
    A negative cd gives a negative T; the reference flips its sign: we keep the
    absolute value and flag the case in ``cd_negative``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    p0, c0, l0 = F.lag(p).over(w), F.lag(c).over(w), F.lag(ll).over(w)
    out = fits.withColumn("cd", (p0 * c0 - F.col(p) * F.col(c)) / (p0 - F.col(p)))
    out = out.withColumn("__t", F.lit(-2.0) * (l0 - F.col(ll)) / F.col("cd"))
    out = out.withColumns({"cd_negative": F.col("cd") < 0,
                           "trd": F.abs(F.col("__t")),
                           "dif_df_trd": F.col(p) - p0})
    out = out.withColumn("p_trd", F.round(ST.chi2_upper("trd", "dif_df_trd"), digits))
    return out.drop("__t")


def step_compare(fits: DataFrame, keys: Sequence[str], step: str = "n_classes",
                 ll: str = "ll", p: str = "parameters", n: str = "n") -> DataFrame:
    """C8 + C10: each model against the model with one class (or step) fewer in its group.

    An equi-join on (keys, step = step + 1); the fits table is one row per model,
    so the join is one-to-one.  Adds the 2 x LL difference, the parameter
    difference and the adjusted statistic x / (1 + 1 / (dp ln n)).
    """
    prev = fits.select(*[F.col(k) for k in keys], (F.col(step) + 1).alias(step),
                       F.col(ll).alias("ll_prev"), F.col(p).alias("p_prev"))
    out = fits.join(prev, list(keys) + [step], "left")
    out = out.withColumns({"lrt": F.lit(2.0) * (F.col(ll) - F.col("ll_prev")),
                           "dp": F.col(p) - F.col("p_prev")})
    return out.withColumn("lrt_adjusted", ST.adjusted_lrt("lrt", "dp", n))


def compare_nested(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), ll: str = "ll",
                   p: str = "parameters") -> DataFrame:
    """LR test between fits a and b (a nested in b), per key; without keys both have one row."""
    x = a.select(*keys, F.col(ll).alias("ll_a"), F.col(p).alias("p_a"))
    y = b.select(*keys, F.col(ll).alias("ll_b"), F.col(p).alias("p_b"))
    if keys:
        x = x.join(y, list(keys))
    else:
        more = [name for name, t in (("a", a), ("b", b)) if len(t.select(ll).take(2)) > 1]
        if more:
            raise ValueError(f"several fits in {more}: give their keys")
        x = x.crossJoin(F.broadcast(y))
    x = x.withColumns({"chisq": F.lit(2.0) * (F.col("ll_b") - F.col("ll_a")), "dif_df": F.col("p_b") - F.col("p_a")})
    return x.withColumn("p_value", ST.chi2_upper("chisq", "dif_df"))


def rank_starts(starts: DataFrame, keys: Sequence[str], ll: str = "ll", digits: int = 3) -> DataFrame:
    """Rank starts from best to worst final log-likelihood; the best value is
    replicated when it appears at least twice at ``digits`` decimals.

    The rank is 1 + the starts of the key with a larger value.  Starts are counted
    by (key, value) first, and only those counts are range-sorted; the best value and
    its count are plain aggregates.  No key's starts meet in one task.
    """
    from trajectra.operators.joins import checked_broadcast, left_null_safe
    rows = starts.withColumn("ll_rounded", F.round(F.col(ll), digits))
    counts = rows.groupBy(*keys, "ll_rounded").agg(F.count(F.lit(1)).alias("__c"))
    idx = dense_index(counts, [F.col(k).asc_nulls_first() for k in keys] + [F.col("ll_rounded").desc_nulls_last()], "__i")
    # counts of all larger values, over partitions of the sorted table: a partition's sum, then inside it
    part = F.floor(F.col("__i") / F.lit(PER_PART))
    inside = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    idx = idx.withColumn("__p", part).withColumn("__before", F.coalesce(F.sum("__c").over(inside), F.lit(0)))
    whole = idx.groupBy("__p").agg(F.sum("__c").alias("__s"))
    offsets = whole.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__s").over(
        Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    idx = idx.join(offsets, F.col("__p") == F.col("__q")).withColumn("__at", F.col("__before") + F.col("__off"))
    first = idx.groupBy(*keys).agg(F.min("__at").alias("__first"), F.max("ll_rounded").alias("__best"),
                                   F.max_by("__c", "ll_rounded").alias("n_best"))
    first = checked_broadcast(first.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__first", "__best", "n_best"))
    ranked = left_null_safe(idx, first, [(k, f"__k_{k}") for k in keys])
    ranked = ranked.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("ll_rounded").alias("__ll"),
                           (F.col("__at") - F.col("__first") + 1).cast("int").alias("rank"), "n_best")
    out = left_null_safe(rows, ranked, [(k, f"__r_{k}") for k in keys] + [("ll_rounded", "__ll")])
    return out.withColumn("best_replicated", F.col("n_best") >= 2)


def class_share(logits: DataFrame, keys: Sequence[str], logit: str = "logit") -> DataFrame:
    """Class proportions from class logits (the last class's logit is 0): softmax."""
    w = Window.partitionBy(*keys)
    return logits.withColumn("share", F.exp(F.col(logit)) / F.sum(F.exp(F.col(logit))).over(w))


def collapse_text(df: DataFrame, keys: Sequence[str], col: str, order: str, sep: str = ",",
                  name: str | None = None) -> DataFrame:
    """A1: ordered text collapse per group; NULL if any piece is NULL (as str_c).

    collect_list runs as a partial aggregate; the pieces of one group are the lines
    of one model report or one document, so a group's list is bounded by its text.
    Use it for such keys only: the text of a group is one value of one row.
    """
    name = name or col
    agg = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("v")))),
                                   lambda s: s["v"]), sep)
    return df.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > F.count(F.col(col)), F.lit(None).cast("string")).otherwise(agg).alias(name))


def fit_table(fits: DataFrame, keys: Sequence[str], class_text: DataFrame | None = None,
              messages: DataFrame | None = None) -> DataFrame:
    """One row per model: fit statistics + class counts/shares as text + messages."""
    out = fits
    if class_text is not None:
        out = out.join(class_text, list(keys), "left")
    if messages is not None:
        out = out.join(messages, list(keys), "left")
    return out


def step_gap(fits: DataFrame, keys: Sequence[str], step: str = "n_classes", ll: str = "LL",
             printed_prev: str = "T11_KM1LL") -> DataFrame:
    """The k-1 class log-likelihood a report prints for its class-count test
    against the k-1 model's own best log-likelihood (one-to-one self equi-join).

    ``gap`` = printed - own; a negative gap means the test used a worse (local)
    k-1 solution than the k-1 model found.
    """
    prev = fits.select(*[F.col(k) for k in keys], (F.col(step) + 1).alias(step), F.col(ll).alias("ll_prev_own"))
    out = fits.join(prev, list(keys) + [step], "left")
    return out.withColumn("gap", F.col(printed_prev) - F.col("ll_prev_own"))

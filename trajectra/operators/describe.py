"""Panel description.

Long panel: (subject, wave, y).  Wide panel: subject + one column per wave.
Every statistic is a partial (map-side combined) aggregate, so the shuffle is
bounded by the number of groups, never by the data.  Pair-wise statistics (A5,
A14) are computed from the wide row of each subject, so no pairs of rows within a
subject are ever formed.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajectra.operators.joins import checked_broadcast


def with_grand_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach the single row of a global aggregate to every row.

    ``total`` is an aggregate without grouping keys, so it has exactly one row;
    broadcasting it is bounded by construction.
    """
    return df.crossJoin(F.broadcast(total))


def frequency(df: DataFrame, col: str) -> DataFrame:
    """A2: n, percent of all rows, percent of non-missing rows (NULL is its own row).

    The totals are sums of the counts, so the input is read once (the plan reuses
    the exchange of the counts).
    """
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"),
                       F.sum(F.when(F.col(col).isNotNull(), F.col("n"))).alias("__valid"))
    return (with_grand_total(counts, total)
            .select(col, "n",
                    (F.col("n") * 100.0 / F.col("__all")).alias("pct"),
                    F.when(F.col(col).isNull(), F.lit(None).cast("double"))
                     .otherwise(F.col("n") * 100.0 / F.col("__valid")).alias("valid_pct")))


def wave_moments(panel: DataFrame, wave: str = "wave", y: str = "y") -> DataFrame:
    """A3: per wave n, mean, population variance, skewness, excess kurtosis,
    min, max and the percent of values at the min and at the max.

    One map-side combined aggregate per wave with Spark's own moments, which merge
    centred sums and so keep their digits on large means; a second counts the
    values at the extremes against the one row per wave.
    """
    data = panel.where(F.col(y).isNotNull()).select(wave, y)
    spread = F.var_pop(y)
    m = data.groupBy(wave).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), spread.alias("variance"),
        F.when(spread > 0, F.skewness(y)).alias("skewness"), F.when(spread > 0, F.kurtosis(y)).alias("kurtosis"),
        F.min(y).alias("min"), F.max(y).alias("max"))
    m = checked_broadcast(m)
    ends = data.join(m.select(wave, "min", "max"), wave).groupBy(wave).agg(
        F.count(F.when(F.col(y) == F.col("min"), 1)).alias("__lo"),
        F.count(F.when(F.col(y) == F.col("max"), 1)).alias("__hi"))
    return m.join(ends, wave).select(
        wave, "n", "mean", "variance", "skewness", "kurtosis", "min", "max",
        (F.col("__lo") * 100.0 / F.col("n")).alias("pct_min"), (F.col("__hi") * 100.0 / F.col("n")).alias("pct_max"))


BRACKET = 10_000        # accuracy of the sketch that brackets a percentile: 1 / BRACKET of the rows


def wave_percentiles(panel: DataFrame, ps: Sequence[float] = (0.2, 0.4, 0.5, 0.6, 0.8),
                     wave: str = "wave", y: str = "y") -> DataFrame:
    """A4: exact percentiles by the report's rule: the value at ascending rank
    max(1, floor(p * n + 0.5)) within each wave.

    Neither sorted nor exchanged as a whole: a mergeable sketch per wave brackets
    every wanted rank within a few ten-thousandths of the rows; a second pass counts
    the values below each bracket and forwards those inside, combined by value, and
    only these are put in order.
    """
    data = panel.where(F.col(y).isNotNull()).select(wave, y)
    d = 2.0 / BRACKET
    edges = [e for p in ps for e in (max(0.0, p - d), min(1.0, p + d))]
    sketch = data.groupBy(wave).agg(F.count(F.lit(1)).alias("n"),
                                    F.percentile_approx(y, [float(e) for e in edges], BRACKET).alias("__e"),
                                    F.min(y).alias("__min"), F.max(y).alias("__max"))
    # below 2 / d rows (10,000) a bracket is narrower than the rounding of ranks: the whole wave is put in order
    few = F.col("n") * d < 2
    lo = [F.when(few | F.lit(p - d <= 0), F.col("__min")).otherwise(F.get("__e", F.lit(2 * i))) for i, p in enumerate(ps)]
    hi = [F.when(few | F.lit(p + d >= 1), F.col("__max")).otherwise(F.get("__e", F.lit(2 * i + 1))) for i, p in enumerate(ps)]
    brackets = checked_broadcast(sketch.select(wave, "n", F.array(*[
        F.struct(F.lit(float(p)).alias("p"), a.alias("lo"), b.alias("hi")) for p, a, b in zip(ps, lo, hi)]).alias("__b")))
    met = data.join(brackets, wave)
    below = met.groupBy(wave, "n").agg(*[F.count(F.when(F.col(y) < F.col("__b")[i]["lo"], 1)).alias(f"__below_{i}")
                                         for i in range(len(ps))])
    below = below.select(wave, "n", F.posexplode(F.array(*[F.col(f"__below_{i}") for i in range(len(ps))])).alias("__i", "__below"))
    below = below.withColumn("__rank", F.greatest(F.lit(1), F.floor(F.element_at(
        F.array(*[F.lit(float(p)) for p in ps]), F.col("__i") + 1) * F.col("n") + 0.5)) - F.col("__below"))
    inside = F.filter(F.transform("__b", lambda b, i: F.when((F.col(y) >= b["lo"]) & (F.col(y) <= b["hi"]), i)),
                      lambda i: i.isNotNull())
    near = (met.select(wave, y, F.explode(inside).alias("__i"))
            .groupBy(wave, "__i", y).agg(F.count(F.lit(1)).alias("__c")))
    upto = Window.partitionBy(wave, "__i").orderBy(y).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__to", F.sum("__c").over(upto))
    found = near.join(below, [wave, "__i"]).where(
        (F.col("__rank") <= F.col("__to")) & (F.col("__rank") > F.col("__to") - F.col("__c")))
    return found.select(wave, F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("__i") + 1).alias("p"), "n",
                        F.col(y).alias("value"))


def coverage(wide: DataFrame, cols: Sequence[str], names: Sequence | None = None) -> DataFrame:
    """A5: share of subjects with both waves present, lower triangle (i >= j).

    One global aggregate of W(W+1)/2 conditional counts over the wide rows,
    then unpivoted to (row, col, coverage).
    """
    names = list(names) if names is not None else list(cols)
    aggs = [F.count(F.lit(1)).alias("__N")]
    for i, ci in enumerate(cols):
        for j in range(i + 1):
            cj = cols[j]
            aggs.append(F.sum(F.when(F.col(ci).isNotNull() & F.col(cj).isNotNull(), 1).otherwise(0))
                        .alias(f"__c_{i}_{j}"))
    tot = wide.agg(*aggs)
    stack = ", ".join(f"{i}, {j}, __c_{i}_{j}" for i in range(len(cols)) for j in range(i + 1))
    n_pairs = len(cols) * (len(cols) + 1) // 2
    return tot.selectExpr("__N", f"stack({n_pairs}, {stack}) AS (i, j, n_both)").select(
        F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"),
        F.col("n_both").cast("long").alias("n_both"),
        (F.col("n_both") / F.col("__N")).alias("coverage"))


def low_coverage(cov: DataFrame, limit: float = 0.1) -> DataFrame:
    """Pairs whose coverage is below the limit."""
    return cov.where(F.col("coverage") < limit)


def presence_text(cols: Sequence[str]):
    """Pattern as text, 'x' present and '.' missing, in wave order (any number of waves)."""
    return F.concat(*[F.when(F.col(c).isNotNull(), F.lit("x")).otherwise(F.lit(".")) for c in cols])


def missing_patterns(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct presence patterns with their subject counts."""
    return wide.groupBy(presence_text(cols).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def pattern_stats(wide: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per missing pattern n, sum y_t and sum y_t * y_s (s <= t).

    These are the sufficient statistics of every one-class normal model on the
    panel; one row per pattern that occurs, whatever the number of subjects.
    """
    y = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(y[t]).alias(f"s_{t}") for t in range(len(cols))]
    aggs += [F.sum(y[t] * y[s]).alias(f"ss_{t}_{s}") for t in range(len(cols)) for s in range(t + 1)]
    return wide.groupBy(presence_text(cols).alias("pattern")).agg(*aggs)


def pattern_stats_long(stats: DataFrame, waves: int) -> DataFrame:
    """A14 as rows: (pattern, n, t, s, value), s NULL for the plain sums."""
    cells = [f"{t}, CAST(NULL AS INT), s_{t}" for t in range(waves)]
    cells += [f"{t}, {s}, ss_{t}_{s}" for t in range(waves) for s in range(t + 1)]
    return stats.selectExpr("pattern", "n", f"stack({len(cells)}, {', '.join(cells)}) AS (t, s, value)")

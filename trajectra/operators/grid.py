"""Model specification grids.

A grid replaces the reference's template engine: each iterator is a small list,
the grid is their cross product (bounded by the list lengths), and everything a
template would have written is a column of the spec row.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectra.operators.joins import checked_broadcast

# Model families of the reference's three grids.
#   growth curve (one class): factors i | i s | i s q; residuals constrained or not
#   class growth: restrictions iq@0 (no random effect) and sq@0 (random intercept)
#   growth mixture: iq@0, sq@0, " q@0" (random i and s, shared),
#                   "c. i" (class-specific intercept variance), "c.is" (class-specific i, s)
GROWTH_TITLES = {0: "unconditional means     model", 1: "unconditional linear    model",
                 2: "unconditional quadratic model"}
RESTRICTIONS = ["iq@0", "sq@0", " q@0", "c. i", "c.is"]


def cross_grid(*lists: DataFrame) -> DataFrame:
    """Cross product of iterator lists (each a small DataFrame of one column).

    Every list is a configuration list; the product is the model count.  A list is
    broadcast after its rows are counted.
    """
    return reduce(lambda a, b: a.crossJoin(checked_broadcast(b)), lists)


def free_parameters(n_factors: Column, n_classes: Column, restriction: Column,
                    shared_residual: Column, waves: int) -> Column:
    """Free parameters of a spec row.

    class means (K x factors) + random-effect (co)variances (by restriction) +
    residual variances (1 if constrained, else one per wave) + K - 1 class logits.
    """
    f, k = n_factors, n_classes
    psi = (F.when(restriction.isNull(), f * (f + 1) / 2)
           .when(restriction == "iq@0", 0)
           .when(restriction == "sq@0", 1)
           .when(restriction == " q@0", 3)
           .when(restriction == "c. i", k + 2)
           .when(restriction == "c.is", 3 * k))
    resid = F.when(shared_residual, F.lit(1)).otherwise(F.lit(waves))
    return (k * f + psi + resid + (k - 1)).cast("int")


def expand_classes_of_spec(grid: DataFrame, classes: str = "n_classes") -> DataFrame:
    """One row per (spec, class k <= n_classes): the conditional class blocks."""
    return grid.select("*", F.explode(F.sequence(F.lit(1), F.col(classes))).alias("class"))


def lookup_by_index(grid: DataFrame, index: str, values: Sequence, name: str) -> DataFrame:
    """Value of a list at a 1-based iterator index (``name#iterator``)."""
    arr = F.array(*[F.lit(v) for v in values])
    return grid.withColumn(name, F.element_at(arr, F.col(index)))


def title(grid: DataFrame, template: str, cols: Sequence[str], name: str = "title") -> DataFrame:
    """Model title/file name from the spec row (printf-style template)."""
    return grid.withColumn(name, F.format_string(template, *[F.col(c) for c in cols]))

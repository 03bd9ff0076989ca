"""Joins (J1-J4).  Lookups are plain equi-joins: Catalyst (and AQE, from measured
sizes) chooses broadcast-hash or sort-merge; nothing is broadcast on faith
(``checked_broadcast`` counts first)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectra.session import stage


BROADCAST_ROWS = 100_000


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``limit`` rows, and as it is beyond that.

    The table is staged first, so the count and the join compute it once.
    """
    small = stage(small, "small")
    return F.broadcast(small) if small.count() <= limit else small


def left_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join on one or more keys (NULL keys never match, as SQL)."""
    return left.join(right, list(keys), "left")


def left_null_safe(left: DataFrame, right: DataFrame, key_pairs: Sequence[tuple[str, str]],
                   drop_right_keys: bool = True) -> DataFrame:
    """Left join where missing matches missing on every key (``<=>``).

    The condition is a conjunction of null-safe equalities, which Catalyst still
    plans as a hash or sort-merge join on the keys (no cross product).
    """
    cond = reduce(lambda a, b: a & b, [left[lk].eqNullSafe(right[rk]) for lk, rk in key_pairs])
    out = left.join(right, cond, "left")
    if drop_right_keys:
        for lk, rk in key_pairs:
            if lk == rk:
                out = out.drop(right[rk])
            else:
                out = out.drop(rk)
    return out


def assert_unique(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Key groups that map to more than one distinct value (the offenders).

    A right side must be a function of the join keys before it is joined, or the
    join fans out; an empty result means it is safe.
    """
    return (df.groupBy(*keys).agg(F.count_distinct(F.col(value)).alias("n_distinct"))
            .where(F.col("n_distinct") > 1))

"""Scalar statistics for model comparison.

Each formula is Spark SQL text over column names, which ``F.expr`` turns into a
Catalyst expression.  The oracle twins are written in another way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _log_gamma_half(df: str) -> str:
    """ln Gamma(df / 2) for an integer df >= 1, as a sum of logarithms."""
    even = f"aggregate(sequence(1, greatest(1, {df} div 2 - 1)), 0.0D, (s, i) -> s + ln(i))"
    odd = (f"aggregate(sequence(0, greatest(0, ({df} - 1) div 2 - 1)), {0.5 * math.log(math.pi)!r}D, "
           "(s, i) -> s + ln(i + 0.5D))")
    return (f"(CASE WHEN {df} IN (1, 2) THEN {{one_two}} WHEN {df} % 2 = 0 THEN {even} ELSE {odd} END)"
            .replace("{one_two}", f"CASE WHEN {df} = 1 THEN {0.5 * math.log(math.pi)!r}D ELSE 0.0D END"))


def chi2_upper_sql(x: str, df: str) -> str:
    """Upper tail P(X > x) of a chi-square with any integer df >= 1 (C6), as Spark SQL text.

    The regularised incomplete gamma function Q(a, h), a = df/2, h = x/2: its power
    series below h = a + 1 and its continued fraction above (evaluated from the far
    end), so small tails keep their digits.  Both converge within a multiple of
    sqrt(a) terms.
    """
    d, h = f"CAST({df} AS INT)", f"(CAST({x} AS DOUBLE) / 2.0D)"
    a = f"({d} / 2.0D)"
    terms = f"CAST(100 + 20 * sqrt({a}) AS INT)"
    front = f"exp(-{h} + {a} * ln({h}) - {_log_gamma_half(d)})"
    series = (f"aggregate(sequence(1, {terms}), named_struct('t', 1.0D / {a}, 's', 1.0D / {a}), "
              f"(z, i) -> named_struct('t', z.t * {h} / ({a} + i), 's', z.s + z.t * {h} / ({a} + i)), z -> z.s)")
    fraction = (f"aggregate(sequence({terms}, 1, -1), {h} + 2.0D * {terms} + 1.0D - {a}, "
                f"(f, i) -> {h} + 2.0D * i - 1.0D - {a} - i * (i - {a}) / f)")
    return (f"(CASE WHEN ({x}) IS NULL OR ({df}) IS NULL OR {d} < 1 THEN CAST(NULL AS DOUBLE) WHEN ({x}) <= 0 THEN 1.0D "
            f"WHEN {h} < {a} + 1.0D THEN greatest(0.0D, 1.0D - {front} * {series}) ELSE {front} / {fraction} END)")


def chi2_upper(x: str, df: str) -> Column:
    """C6 as a Column over column names."""
    return F.expr(chi2_upper_sql(x, df))


# ----------------------------------------------------------------- C1-C3, C7, C8

def _d(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def deviance_sql(ll: str) -> str:
    return f"(-2.0 * ({ll}))"


def aic_sql(ll: str, p: str) -> str:
    return f"(-2.0 * ({ll}) + 2.0 * {_d(p)})"


def bic_sql(ll: str, p: str, n: str) -> str:
    return f"(-2.0 * ({ll}) + {_d(p)} * ln({_d(n)}))"


def abic_sql(ll: str, p: str, n: str) -> str:
    """Sample-size adjusted BIC, n* = (n + 2) / 24."""
    return f"(-2.0 * ({ll}) + {_d(p)} * ln(({_d(n)} + 2.0) / 24.0))"


def aicc_sql(ll: str, p: str, n: str) -> str:
    return f"({aic_sql(ll, p)} + 2.0 * {_d(p)} * ({_d(p)} + 1.0) / ({_d(n)} - {_d(p)} - 1.0))"


def wald_z_sql(est: str, se: str) -> str:
    """Est / se, 999 when se is 0 (the report's not-applicable code)."""
    return f"(CASE WHEN ({se}) = 0 THEN 999.0 ELSE ({est}) / ({se}) END)"


def wald_p_sql(est: str, se: str) -> str:
    """Two-sided p of z, i.e. the df-1 chi-square tail of z^2."""
    z = f"(({est}) / nullif({se}, 0))"
    return f"(CASE WHEN ({se}) = 0 THEN 999.0 ELSE {chi2_upper_sql(f'({z} * {z})', '1')} END)"


def adjusted_lrt_sql(x: str, dp: str, n: str) -> str:
    """Adjusted class-count statistic x / (1 + 1 / (dp ln n))."""
    return f"({_d(x)} / (1.0 + 1.0 / ({_d(dp)} * ln({_d(n)}))))"


def deviance(ll: str) -> Column:
    return F.expr(deviance_sql(ll))


def aic(ll: str, p: str) -> Column:
    return F.expr(aic_sql(ll, p))


def bic(ll: str, p: str, n: str) -> Column:
    return F.expr(bic_sql(ll, p, n))


def abic(ll: str, p: str, n: str) -> Column:
    return F.expr(abic_sql(ll, p, n))


def aicc(ll: str, p: str, n: str) -> Column:
    return F.expr(aicc_sql(ll, p, n))


def wald(est: str, se: str) -> tuple[Column, Column]:
    return F.expr(wald_z_sql(est, se)), F.expr(wald_p_sql(est, se))


def adjusted_lrt(x: str, dp: str, n: str) -> Column:
    return F.expr(adjusted_lrt_sql(x, dp, n))

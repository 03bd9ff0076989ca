"""A grid of models of panel E as DuckDB SQL: the twin of ``grid_fit.grid_steps``."""

from __future__ import annotations

from collections.abc import Sequence

from trajectra.operators.fit import RESTRICTION_SPEC
from trajectra.operators.grid_fit import unit_starts
from trajectra.plans.em_sql import em_ctes

TITLE = "%s-lcga2 - unconditional quadratic model - {restriction} -{classes} classes-residuals {residuals}"


def title(restriction: str, classes: int, shared: bool) -> str:
    return TITLE.format(restriction=restriction, classes=classes, residuals="constrained" if shared else "unconstrained")


def grid_sql(panel: str, classes: Sequence[int], restrictions: Sequence[str], residual_rules: Sequence[bool], steps: int, starts: int,
             seed: int = 7) -> str:
    """CTEs up to ``best`` (a row per model, at its best start) and ``best_classes`` (a row per model and class).

    ``panel``: CTEs that end in panel_g (outcome, subject, wave, y).  Parameters, class
    sums and likelihoods belong to the parameters before the last EM step.
    """
    units = ", ".join(f"({k}, {i}, {u.seed}, {c + 1}, {u.offset[c]!r}, {u.slope[c]!r}, {u.curve[c]!r}, {u.scale!r}, {u.share[c]!r})"
                      for k in classes for i, u in enumerate(unit_starts(k, starts, seed)) for c in range(k))
    ctes = [panel.strip(),
            "waves AS MATERIALIZED (SELECT outcome, wave, avg(y) AS m, var_pop(y) AS v FROM panel_g GROUP BY outcome, wave)",
            """stats AS MATERIALIZED (
  SELECT w.outcome, avg(m) AS base, sqrt(avg(v)) AS sd, max(wave) + 1 AS nw, any_value(c.n) AS n
  FROM waves w JOIN (SELECT outcome, count(DISTINCT subject) AS n FROM panel_g GROUP BY outcome) c ON c.outcome = w.outcome GROUP BY w.outcome)""",
            f"units AS (SELECT * FROM (VALUES {units}) v(classes, start, seed, class, off, slope, curve, scale, share))"]
    last = steps - 1
    parts, class_parts = [], []
    for j, (r, shared) in enumerate((r, s) for r in restrictions for s in residual_rules):
        free = RESTRICTION_SPEC[r][0]
        pre = f"c{j}_"
        psi = [f"0.25 * sd * sd / {1.0 + 10.0 * f} * scale" if f in free else "0.0" for f in (0, 1)]
        ctes.append(f"""{pre}par0 AS MATERIALIZED (
  SELECT outcome || '|' || classes || '|' || start AS g, class, base + sd * off AS a0, sd / nw * slope AS a1, sd / (nw * nw) * curve AS a2,
         {psi[0]} AS p00, 0.0 AS p01, {psi[1]} AS p11, share AS pi FROM stats CROSS JOIN units)""")
        ctes.append(f"""{pre}g AS MATERIALIZED (
  SELECT DISTINCT outcome || '|' || classes || '|' || start AS g, outcome, classes, start, seed, n, nw, sd FROM stats CROSS JOIN units)""")
        ctes.append(f"""{pre}th0 AS MATERIALIZED (
  SELECT k.g, w.wave, greatest(0.5 * sd * sd, 0.001) AS th FROM {pre}g k JOIN waves w ON w.outcome = k.outcome)""")
        ctes.append(f"{pre}panel AS MATERIALIZED (SELECT k.g, p.subject, p.wave, p.y FROM panel_g p JOIN {pre}g k ON k.outcome = p.outcome)")
        ctes += em_ctes(steps, len(free), False, shared, True, pre, f"{pre}panel", True)[:-1]
        free_parameters = {"iq@0": 0, "sq@0": 1, " q@0": 3}[r]
        ctes.append(f"""{pre}res AS (
  SELECT printf('{title(r, 0, shared).replace("-0 classes", "-%d classes")}', k.outcome, k.classes) AS model, k.*, '{r}' AS restriction,
         '{"constrained" if shared else "unconstrained"}' AS residuals, l.ll,
         3 * classes + {free_parameters} + {1 if shared else "nw"} + classes - 1 AS parameters,
         CASE WHEN classes > 1 THEN 1.0 - e.h / (n * ln(classes)) END AS entropy
  FROM {pre}g k JOIN {pre}ll{steps} l ON l.g = k.g
  JOIN (SELECT g, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0.0 END) AS h FROM {pre}w{steps} GROUP BY g) e ON e.g = k.g)""")
        ctes.append(f"""{pre}cls AS (
  SELECT r.model, r.start, sqrt(s.v0 + tm * tm * s.v1 + power(t2m - bq * tm, 2) * s.v2) AS se_0, sqrt(s.v1 + bq * bq * s.v2) AS se_1,
         sqrt(s.v2) AS se_2, c.class, c.a0, c.a1, c.a2, c.p00, c.pi, c.pi * r.n AS model_count, w.posterior_count, w.likely_count
  FROM {pre}res r JOIN {pre}par{last} c ON c.g = r.g
  JOIN (SELECT g, class, sum(p) AS posterior_count, CAST(count(*) FILTER (k = 1) AS DOUBLE) AS likely_count FROM (
          SELECT *, row_number() OVER (PARTITION BY g, subject ORDER BY p DESC, class) AS k FROM {pre}w{steps}) x GROUP BY g, class) w
    ON w.g = c.g AND w.class = c.class
  JOIN (SELECT g, class, 1.0 / sum(sw / th) AS v0, 1.0 / sum(sw / th * u * u) AS v1, 1.0 / sum(sw / th * q * q) AS v2, any_value(tm) AS tm,
               any_value(t2m) AS t2m, any_value(bq) AS bq FROM {pre}v{steps} GROUP BY g, class) s ON s.g = c.g AND s.class = c.class)""")
        parts.append(f"SELECT * FROM {pre}res")
        class_parts.append(f"SELECT * FROM {pre}cls")
    ctes.append(f"res AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    ctes.append(f"cls AS ({' UNION ALL '.join(class_parts)})")
    ctes.append("""ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(ll, 3) DESC, start) AS k,
         count(*) FILTER (round(ll, 3) = round(top, 3)) OVER (PARTITION BY model) >= 2 AS best_replicated
  FROM (SELECT *, max(ll) OVER (PARTITION BY model) AS top FROM res) x)""")
    ctes.append("best AS MATERIALIZED (SELECT * FROM ranked WHERE k = 1)")
    ctes.append("best_classes AS MATERIALIZED (SELECT c.* FROM cls c JOIN best b ON b.model = c.model AND b.start = c.start)")
    return "WITH " + ",\n".join(ctes) + "\n"

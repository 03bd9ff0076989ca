"""EM steps of growth models as DuckDB SQL, unrolled: the twins of the fitters.

Written for random effects on intercept and slope only, with the 2x2 closed forms
of the precision of the random effects (Psi^-1 + G), unlike the fitter's M = I + Psi G.
The M step's means are a weighted regression by successive orthogonal terms.
"""

from __future__ import annotations

from trajectra.plans.panels import PANEL_P_SQL


def start_rows(starts: list[list[dict]]) -> str:
    """VALUES rows (start, class, a0, a1, a2, p00, p01, p11, pi)."""
    return ", ".join(f"({g}, {k}, {c['a'][0]!r}, {c['a'][1]!r}, {c['a'][2]!r}, {c['psi'][0]!r}, {c['psi'][1]!r}, {c['psi'][2]!r}, {c['pi']!r})"
                     for g, classes in enumerate(starts) for k, c in enumerate(classes, 1))


def em_steps_sql(starts: list[list[dict]], theta: float, steps: int, random: int, per_class: bool = False,
                 shared_residual: bool = False, quadratic: bool = True) -> str:
    """``steps`` EM steps from ``starts``; every wave's first residual variance is ``theta``.

    ``random``: how many of intercept and slope vary (0, 1 or 2).  Ends in a CTE ``em``
    (start, class, wave, mean, th, p00, p01, p11, pi, ll); ll is that before the last step.
    """
    ctes = [f"par0 AS MATERIALIZED (SELECT * FROM (VALUES {start_rows(starts)}) v(g, class, a0, a1, a2, p00, p01, p11, pi))",
            f"th0 AS MATERIALIZED (SELECT DISTINCT g, wave, CAST({theta!r} AS DOUBLE) AS th FROM panel_p, (SELECT DISTINCT g FROM par0) s)"]
    ctes += em_ctes(steps, random, per_class, shared_residual, quadratic)
    return "WITH" + PANEL_P_SQL + ",\n" + ",\n".join(ctes) + "\n"


def em_ctes(steps: int, random: int, per_class: bool = False, shared_residual: bool = False, quadratic: bool = True,
            pre: str = "", panel: str = "panel_p", keyed: bool = False) -> list[str]:
    """The CTEs of ``steps`` EM steps from CTEs ``{pre}par0`` (g, class, a0, a1, a2, p00, p01, p11, pi) and ``{pre}th0`` (g, wave, th).

    ``panel``: (subject, wave, y), or with ``keyed`` (g, subject, wave, y), each start on rows of its own.
    """
    ctes = []
    if random == 0:
        cov = "0.0 AS d00, 0.0 AS d01, 0.0 AS d11, 0.0 AS ldet"
    elif random == 1:
        cov = "p00 / (1.0 + p00 * s0) AS d00, 0.0 AS d01, 0.0 AS d11, ln(1.0 + p00 * s0) AS ldet"
    else:
        q = "(p00 * p11 - p01 * p01)"
        h00, h01, h11 = f"(p11 / {q} + s0)", f"(s1 - p01 / {q})", f"(p00 / {q} + s2)"
        det = f"({h00} * {h11} - {h01} * {h01})"
        cov = f"{h11} / {det} AS d00, -{h01} / {det} AS d01, {h00} / {det} AS d11, ln({q} * {det}) AS ldet"
    for i in range(steps):
        n = i + 1
        ctes.append(f"""{pre}r{n} AS (
  SELECT c.g, c.class, p.subject, p.wave, CAST(p.wave AS DOUBLE) AS t, p.y, h.th,
         p.y - c.a0 - c.a1 * p.wave - c.a2 * p.wave * p.wave AS e, c.p00, c.p01, c.p11, c.pi
  FROM {panel} p {"JOIN" if keyed else "CROSS JOIN"} {pre}par{i} c {"ON c.g = p.g" if keyed else ""} JOIN {pre}th{i} h ON h.g = c.g AND h.wave = p.wave)""")
        ctes.append(f"""{pre}s{n} AS (
  SELECT g, class, subject, any_value(p00) AS p00, any_value(p01) AS p01, any_value(p11) AS p11, any_value(pi) AS pi,
         sum(1.0 / th) AS s0, sum(t / th) AS s1, sum(t * t / th) AS s2, sum(e / th) AS u0, sum(t * e / th) AS u1,
         sum(e * e / th) AS c, sum(ln(th)) AS lt, count(*) AS n FROM {pre}r{n} GROUP BY g, class, subject)""")
        ctes.append(f"{pre}d{n} AS (SELECT *, {cov} FROM {pre}s{n})")
        ctes.append(f"""{pre}f{n} AS (
  SELECT *, d00 * u0 + d01 * u1 AS b0, d01 * u0 + d11 * u1 AS b1,
         ln(pi) - 0.5 * (n * ln(2.0 * pi()) + lt + ldet + c - (d00 * u0 * u0 + 2.0 * d01 * u0 * u1 + d11 * u1 * u1)) AS lp FROM {pre}d{n})""")
        ctes.append(f"""{pre}w{n} AS MATERIALIZED (
  SELECT g, class, subject, b0, b1, d00, d01, d11, exp(lp - ll) AS p, ll FROM (
    SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY g, subject)) AS ll FROM (
      SELECT *, max(lp) OVER (PARTITION BY g, subject) AS top FROM {pre}f{n}) x) z)""")
        ctes.append(f"{pre}ll{n} AS (SELECT g, sum(ll) AS ll FROM {pre}w{n} WHERE class = 1 GROUP BY g)")
        ctes.append(f"""{pre}m{n} AS MATERIALIZED (
  SELECT w.g, w.class, x.wave, CAST(x.wave AS DOUBLE) AS t, any_value(h.th) AS th, sum(w.p) AS sw,
         sum(w.p * (x.y - w.b0 - w.b1 * x.wave)) AS sy,
         sum(w.p * (power(x.y - w.b0 - w.b1 * x.wave, 2) + w.d00 + 2.0 * w.d01 * x.wave + w.d11 * x.wave * x.wave)) AS syy
  FROM {pre}w{n} w JOIN {panel} x ON x.subject = w.subject{" AND x.g = w.g" if keyed else ""} JOIN {pre}th{i} h ON h.g = w.g AND h.wave = x.wave GROUP BY w.g, w.class, x.wave)""")
        ctes.append(f"""{pre}o{n} AS (
  SELECT *, t - sum(sw / th * t) OVER c / sum(sw / th) OVER c AS u, sum(sw / th * t) OVER c / sum(sw / th) OVER c AS tm,
         sum(sw / th * t * t) OVER c / sum(sw / th) OVER c AS t2m FROM {pre}m{n} WINDOW c AS (PARTITION BY g, class))""")
        ctes.append(f"""{pre}v{n} AS (
  SELECT *, t * t - t2m - bq * u AS q FROM (
    SELECT *, sum(sw / th * u * t * t) OVER (PARTITION BY g, class) / sum(sw / th * u * u) OVER (PARTITION BY g, class) AS bq FROM {pre}o{n}) x)""")
        c2 = "sum(q * sy / th) / sum(sw / th * q * q)" if quadratic else "0.0"
        ctes.append(f"""{pre}k{n} AS (
  SELECT g, class, sum(sy / th) / sum(sw / th) AS c0, sum(u * sy / th) / sum(sw / th * u * u) AS c1, {c2} AS c2,
         any_value(tm) AS tm, any_value(t2m) AS t2m, any_value(bq) AS bq FROM {pre}v{n} GROUP BY g, class)""")
        ctes.append(f"""{pre}a{n} AS (
  SELECT g, class, c0 - c1 * tm - c2 * (t2m - bq * tm) AS a0, c1 - c2 * bq AS a1, c2 AS a2 FROM {pre}k{n})""")
        over = "PARTITION BY m.g" if shared_residual else "PARTITION BY m.g, m.wave"
        ctes.append(f"""{pre}th{n} AS MATERIALIZED (
  SELECT DISTINCT m.g, m.wave, sum(syy - 2.0 * (a0 + a1 * t + a2 * t * t) * sy + power(a0 + a1 * t + a2 * t * t, 2) * sw)
         OVER ({over}) / sum(sw) OVER ({over}) AS th
  FROM {pre}m{n} m JOIN {pre}a{n} a ON a.g = m.g AND a.class = m.class)""")
        cell = lambda x: f"sum(p * ({x}))"
        split = "" if per_class else " OVER (PARTITION BY g)"
        div = "sp" if per_class else "sum(sp) OVER (PARTITION BY g)"
        psi = {"p00": "q00", "p01": "q01", "p11": "q11"}
        parts = ", ".join(f"{f'sum({v}){split}' if not per_class else v} / {div} AS {c}" if (c == "p00" and random > 0) or random > 1
                          else f"0.0 AS {c}" for c, v in psi.items())
        ctes.append(f"""{pre}x{n} AS (
  SELECT g, class, {cell('1.0')} AS sp, {cell('b0 * b0 + d00')} AS q00, {cell('b0 * b1 + d01')} AS q01, {cell('b1 * b1 + d11')} AS q11
  FROM {pre}w{n} GROUP BY g, class)""")
        ctes.append(f"{pre}y{n} AS (SELECT g, class, {parts}, sp / sum(sp) OVER (PARTITION BY g) AS pi FROM {pre}x{n})")
        ctes.append(f"""{pre}par{n} AS MATERIALIZED (
  SELECT a.g, a.class, a0, a1, a2, p00, p01, p11, pi FROM {pre}a{n} a JOIN {pre}y{n} y ON y.g = a.g AND y.class = a.class)""")
    ctes.append(f"""{pre}em AS (
  SELECT c.g AS start, c.class, h.wave, c.a0 + c.a1 * h.wave + c.a2 * h.wave * h.wave AS mean, h.th, c.p00, c.p01, c.p11, c.pi, l.ll
  FROM {pre}par{steps} c JOIN {pre}th{steps} h ON h.g = c.g JOIN {pre}ll{steps} l ON l.g = c.g)""")
    return ctes


RESULT_SQL = """SELECT CAST(start AS INTEGER) AS start, CAST(class AS INTEGER) AS class, CAST(wave AS INTEGER) AS wave, round(mean, 4) + 0.0 AS mean,
       round(th, 4) AS th, round(p00, 4) + 0.0 AS p00, round(p01, 4) + 0.0 AS p01, round(p11, 4) + 0.0 AS p11,
       round(pi, 4) AS pi, round(ll, 3) AS ll FROM em"""

"""Closed forms of the normal growth model with random effects, as SQL text.

Subject j, observed waves t with time score t, residual variances th_t, class
means a = (a0, a1, a2) on z_t = (1, t, t^2), random effects u ~ N(0, Psi):

  V = Z Psi Z' + diag(th)            (observed rows only)
  G = sum z z' / th,  g = sum z e / th,  C = sum e^2 / th,  e = y - z'a
  M = I + Psi G                      (invertible for any PSD Psi, even singular)
  ln|V|       = sum ln th + ln det M
  e' V^-1 e   = C - g' D g,          D = M^-1 Psi = Cov(u | y)
  E(u | y)    = b = D g

Everything is generated as text over column names and runs as Catalyst expressions
(whole-stage code generation).  ``nm`` maps a base name to a column name (class
suffixes).
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

LN2PI = math.log(2.0 * math.pi)
IDX = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def _id(s: str) -> str:
    return s


def psi(a: int, b: int, nm: Callable[[str], str] = _id) -> str:
    a, b = min(a, b), max(a, b)
    return nm(f"p{a}{b}")


def visit_stats(y: str, t: str, th: str, nm: Callable[[str], str] = _id) -> dict[str, str]:
    """G, g, C, L (= sum ln th) and n of one class as aggregates over a subject's visits.

    ``y``, ``t`` and ``th`` name the value, the time score and the class's residual
    variance of the visit; rows with a NULL y add nothing.  Parameters per class:
    a0, a1, a2 (named through ``nm``).  Nothing depends on the number of waves.
    """
    e = f"({y} - ({nm('a0')} + {nm('a1')} * {t} + {nm('a2')} * {t} * {t}))"
    power = {0: "1.0D", 1: t, 2: f"{t} * {t}", 3: f"{t} * {t} * {t}", 4: f"{t} * {t} * {t} * {t}"}

    def total(x: str) -> str:
        return f"coalesce(sum(CASE WHEN {y} IS NOT NULL THEN {x} END), 0.0D)"

    out = {nm(f"G{a}{b}"): total(f"{power[a + b]} / {th}") for a, b in IDX}
    out.update({nm(f"g{a}"): total(f"{power[a]} * {e} / {th}") for a in range(3)})
    out[nm("C")] = total(f"{e} * {e} / {th}")
    out[nm("L")] = total(f"ln({th})")
    out[nm("n")] = f"CAST(count({y}) AS DOUBLE)"
    return out


def _g(a: int, b: int, nm) -> str:
    a, b = min(a, b), max(a, b)
    return nm(f"G{a}{b}")


def solve_stages(nm: Callable[[str], str] = _id) -> list[dict[str, str]]:
    """Stages 2-4: M = I + Psi G, its inverse, D = M^-1 Psi, b = D g, logf.

    Input columns (through ``nm``): G00..G22, g0..g2, C, L, n, p00..p22.
    Output columns: logf, b0..b2, D00..D22 (and helpers M.., det, quad).
    """
    s2 = {}
    for a in range(3):
        for b in range(3):
            terms = " + ".join(f"{psi(a, c, nm)} * {_g(c, b, nm)}" for c in range(3))
            s2[nm(f"M{a}{b}")] = f"({'1.0 + ' if a == b else ''}{terms})"
    M = {(a, b): nm(f"M{a}{b}") for a in range(3) for b in range(3)}

    def cof(a, b):
        r = [i for i in range(3) if i != a]
        c = [j for j in range(3) if j != b]
        minor = f"({M[r[0], c[0]]} * {M[r[1], c[1]]} - {M[r[0], c[1]]} * {M[r[1], c[0]]})"
        return minor if (a + b) % 2 == 0 else f"(-{minor})"

    s3 = {nm("det"): f"({M[0, 0]} * {cof(0, 0)} + {M[0, 1]} * {cof(0, 1)} + {M[0, 2]} * {cof(0, 2)})"}
    for a in range(3):
        for b in range(3):
            s3[nm(f"cof{a}{b}")] = cof(a, b)
    # D = M^-1 Psi, M^-1[a][c] = cof[c][a] / det
    s4 = {}
    for (a, b) in IDX:
        s4[nm(f"D{a}{b}")] = ("((" + " + ".join(f"{nm(f'cof{c}{a}')} * {psi(c, b, nm)}" for c in range(3))
                              + f") / {nm('det')})")
    s5 = {}
    for a in range(3):
        s5[nm(f"b{a}")] = "(" + " + ".join(f"{_d(a, c, nm)} * {nm(f'g{c}')}" for c in range(3)) + ")"
    s6 = {nm("quad"): "(" + " + ".join(f"{nm(f'g{a}')} * {nm(f'b{a}')}" for a in range(3)) + ")"}
    s7 = {nm("logf"): (f"(-0.5 * ({nm('n')} * {LN2PI!r} + {nm('L')} + ln({nm('det')}) + {nm('C')}"
                       f" - {nm('quad')}))")}
    return [s2, s3, s4, s5, s6, s7]


def _d(a: int, b: int, nm) -> str:
    a, b = min(a, b), max(a, b)
    return nm(f"D{a}{b}")


def helper_columns(nm: Callable[[str], str] = _id) -> list[str]:
    """Intermediate columns that can be dropped after the solve."""
    out = [nm(f"M{a}{b}") for a in range(3) for b in range(3)]
    out += [nm(f"cof{a}{b}") for a in range(3) for b in range(3)]
    out += [nm("det"), nm("quad")]
    return out


def param_columns(W: int) -> list[str]:
    """Per-class parameter columns of a long parameter table."""
    return ["a0", "a1", "a2"] + [f"th_{t}" for t in range(W)] + [f"p{a}{b}" for a, b in IDX] + ["lnpi"]

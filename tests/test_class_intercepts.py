"""The M step of class-specific intercept variances next to a singular covariance."""

import numpy as np

from trajectra.operators import fit as FT


def test_covariance_singular_to_working_precision():
    """The determinant is above 0 by its rounding, and the matrix has no inverse."""
    S, n = np.stack([np.array([[2.0, 0.1], [0.1, 0.5]])] * 2), np.array([3.0, 4.0])
    rng, found = np.random.default_rng(0), []
    while len(found) < 3:
        p, c = rng.uniform(0.1, 9, 2)
        q = c / p * c
        try:
            if p * q - c ** 2 > 0:
                np.linalg.solve(np.array([[p, c], [c, q]]), S[0])
        except np.linalg.LinAlgError:
            found.append((p, c, q))
    for p, c, q in found:
        assert FT._ci_objective(np.array([p, p, c, q]), S, n) == np.inf
        old = np.zeros((2, 2, 2)) + np.array([[p, c], [c, q]])
        psi = FT.ci_psi_step(S, n, old)
        assert np.isfinite(psi).all() and (np.linalg.eigvalsh(psi) > 0).all()

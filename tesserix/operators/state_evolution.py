"""What a fit's denoising step will do, told from the prior alone.

If messages behave as they do in the limit of large random matrices, an effect is seen as itself plus
normal noise of precision gamma.  The mean derivative alpha of the denoiser is then an integral over
a mixture of normal densities, which quadrature gives, and eta = gamma / alpha and the next step's
gamma = eta - gamma follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .markers import denoise
from .prior import Prior

#: Points of the quadrature of each component.
NODES = 200


@dataclass(frozen=True)
class Step:
    alpha: float
    eta: float
    gamma: float


def mean_slope(gamma: float, prior: Prior, nodes: int = NODES) -> float:
    """The denoiser's mean derivative over effects of the prior seen with noise of precision ``gamma``."""
    at, weight = np.polynomial.hermite_e.hermegauss(nodes)
    weight = weight / weight.sum()
    total = 0.0
    for p, v in zip(prior.probs, prior.variances, strict=True):
        total += p * float(weight @ denoise(at * np.sqrt(v + 1 / gamma), gamma, prior)[1])
    return total


def denoising_step(gamma: float, prior: Prior, rho: float = 1.0, gamma_before: float | None = None, prior_before: Prior | None = None) -> Step:
    """alpha (damped with the last iteration's, if that is given), eta, and the precision that the LMMSE
    step is given."""
    alpha = mean_slope(gamma, prior)
    if gamma_before is not None:
        alpha = rho * alpha + (1 - rho) * mean_slope(gamma_before, prior_before or prior)
    eta = gamma / alpha
    return Step(alpha, eta, eta - gamma)


def lmmse_step(gamma: float, gamw: float, spectrum: np.ndarray) -> Step:
    """The same of the LMMSE step over a matrix with the eigenvalues ``spectrum`` of A'A."""
    alpha = float((gamma / (gamw * np.maximum(spectrum, 0.0) + gamma)).mean())
    eta = gamma / alpha
    return Step(alpha, eta, eta - gamma)


def trajectory(gamma: float, gamw: float, prior: Prior, spectrum: np.ndarray, iterations: int) -> list[tuple[Step, Step]]:
    """Both steps of each iteration of an undamped linear fit with a known prior and noise."""
    out = []
    for _ in range(iterations):
        one = denoising_step(gamma, prior)
        two = lmmse_step(max(one.gamma, 1e-11), gamw, spectrum)
        out.append((one, two))
        gamma = max(two.gamma, 1e-11)
    return out

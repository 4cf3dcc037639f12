"""Element-wise functions of the models, as Column expressions that stay in generated code."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Bounds of every precision.
LEAST, MOST = 1e-11, 1e11


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), x))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def mixture_moments(r: Column, gamma: float, probs: list[float], variances: list[float]) -> tuple[Column, Column, Column]:
    """Of the densities p_k N(r; 0, v_k + 1/gamma), all shifted by the widest one's exponent:
    their sum and their sums over v_k + 1/gamma and its square."""
    noise = 1.0 / gamma
    widest = max(variances) + noise
    parts = []
    for p, v in zip(probs, variances, strict=True):
        s = v + noise
        parts.append((F.lit(p / s**0.5) * F.exp(F.lit(-0.5) * r * r * F.lit(1.0 / s - 1.0 / widest)), s))
    return tuple(_total([w / s**k for w, s in parts]) for k in range(3))


def denoise(r: Column, gamma: float, probs: list[float], variances: list[float]) -> Column:
    """Posterior mean of a mixture-distributed effect seen with noise of precision gamma."""
    if abs(1.0 / gamma) < 1e-10:
        return r
    total, once, _ = mixture_moments(r, gamma, probs, variances)
    return r * (1 - F.lit(1.0 / gamma) * once / total)


def denoise_slope(r: Column, gamma: float, probs: list[float], variances: list[float]) -> Column:
    """Derivative of :func:`denoise`."""
    if abs(1.0 / gamma) < 1e-10:
        return F.lit(1.0)
    total, once, twice = mixture_moments(r, gamma, probs, variances)
    mean = r * once / total
    return 1 + F.lit(1.0 / gamma) * ((r * r * twice - once) / total - mean * mean)


def damped(new: Column, old: Column, rho: float) -> Column:
    return F.lit(rho) * new + F.lit(1.0 - rho) * old


def huber_prox(p: Column, tau: float, delta: float, y: Column) -> Column:
    """Proximal point of the Huber loss of y - z at z = p, with precision tau."""
    w = y - p
    step = 1.0 / tau
    inside = F.abs(w) <= (1 + step) * delta
    residual = F.when(inside, w / (1 + step)).otherwise(w - F.signum(w) * delta * step)
    return y - residual


def huber_prox_slope(p: Column, tau: float, delta: float, y: Column) -> Column:
    """Derivative of :func:`huber_prox` in p."""
    step = 1.0 / tau
    return F.when(F.abs(y - p) <= (1 + step) * delta, F.lit(1.0 / (1 + step))).otherwise(F.lit(1.0))


def huber_loss(z: Column, delta: float, y: Column) -> Column:
    w = F.abs(y - z)
    return F.when(w <= delta, w * w / 2).otherwise(delta * (w - delta / 2))


def mixture_log_ratio(x: Column, probs_a, variances_a, probs_b, variances_b) -> Column:
    """log of the ratio of two mixtures of centred normal densities."""
    widest = max(*variances_a, *variances_b)

    def density(probs, variances):
        terms = [
            F.lit(p / v**0.5) * F.exp(F.lit(-0.5) * x * x * F.lit(1.0 / v - 1.0 / widest))
            for p, v in zip(probs, variances, strict=True)
        ]
        return _total(terms)

    return F.log(density(probs_a, variances_a) / density(probs_b, variances_b))


def chromosome_number(token: Column) -> Column:
    """Chromosome of an annotation's first token: X is 23, what is no number is 0."""
    return F.when(token == "X", 23).otherwise(F.coalesce(token.try_cast("double"), F.lit(0.0)).cast("int"))

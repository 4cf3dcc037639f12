"""Expectation maximisation of a spike-and-slab mixture prior."""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.scalars import mixture_moments


@dataclass(frozen=True)
class Prior:
    """Probabilities and variances of the components; the first is the spike at zero."""

    probs: tuple[float, ...]
    variances: tuple[float, ...]

    def __post_init__(self):
        if len(self.probs) != len(self.variances) or not self.probs or self.variances[0] != 0:
            raise ValueError("the prior needs a probability for each variance and a spike of variance 0 first")

    def scaled(self, factor: float) -> "Prior":
        return Prior(self.probs, tuple(v * factor for v in self.variances))

    def merged(self, closeness: float = 0.5) -> "Prior":
        """Components whose variances differ by less than ``closeness`` of the smaller one (1e-7
        for the spike) become one, which keeps the earlier one's variance."""
        probs, variances = list(self.probs), list(self.variances)
        j = 0
        while j < len(probs):
            k = j + 1
            while k < len(probs):
                least = min(variances[j], variances[k]) or 1e-7
                if abs(variances[j] - variances[k]) / least < closeness:
                    probs[j] += probs.pop(k)
                    variances.pop(k)
                else:
                    k += 1
            j += 1
        return Prior(tuple(probs), tuple(variances))


def default_prior(n_markers: int, n_samples: int) -> Prior:
    """The spike and 22 slabs of log-spaced variances from 1e-5 to 1e2 over N, each with half
    the last one's probability; for over 50,000 markers."""
    if n_markers <= 50_000:
        raise ValueError("without probs and vars the prior is defined for over 50,000 markers")
    slab = min(5e4 / n_markers, 1.0)
    weights = [slab / (2 - 2.0**-21) / 2**k for k in range(22)]
    variances = [10 ** (-5 + 7 * k / 21) / n_samples for k in range(22)]
    return Prior((1 - slab, *weights), (0.0, *variances))


def halving_prior(n_markers: int, n_causal: int, components: int) -> Prior:
    """A spike and ``components`` - 1 slabs over half the causal markers, each with half the last
    one's probability and ten times its variance."""
    causal = max(1, n_causal // 2)
    first = causal / n_markers / (2 - 1 / 2 ** (components - 1))
    slabs = range(components - 1)
    return Prior((1 - causal / n_markers, *(first / 2**k for k in slabs)), (0.0, *(0.01 / causal * 10**k for k in slabs)))


def em_sums(state: DataFrame, gamma: float, prior: Prior) -> DataFrame:
    """One row: ``n``, ``pi`` (expected slab markers) and for each slab k ``b<k>`` and ``g<k>``:
    its expected markers and their summed second moments.  One aggregate for all components."""
    noise = 1.0 / gamma
    r = F.col("r")
    widest = max(prior.variances) + noise
    density = [
        F.lit(p / (v + noise) ** 0.5) * F.exp(F.lit(-0.5) * r * r * F.lit(1 / (v + noise) - 1 / widest))
        for p, v in zip(prior.probs, prior.variances, strict=True)
    ]
    total, _, _ = mixture_moments(r, gamma, list(prior.probs), list(prior.variances))
    sums = [F.count("*").alias("n"), F.sum(1 - density[0] / total).alias("pi")]
    for k, v in enumerate(prior.variances[1:], start=1):
        share = density[k] / total
        m = F.lit(gamma / (1 / v + gamma)) * r
        sums += [F.sum(share).alias(f"b{k}"), F.sum(share * (m * m + F.lit(1 / (1 / v + gamma)))).alias(f"g{k}")]
    return state.agg(*sums)


def em_step(state: DataFrame, gamma: float, prior: Prior, learn_variances: bool = True) -> Prior:
    """The prior after one round over ``r``; a component without mass keeps its variance."""
    row = em_sums(state, gamma, prior).first()
    return from_sums(row.asDict(), prior, learn_variances)


def from_sums(s: dict, prior: Prior, learn_variances: bool = True) -> Prior:
    slab = s["pi"] / s["n"]
    slabs = range(1, len(prior.probs))
    probs = [slab * (s[f"b{k}"] / s["pi"] if s["pi"] else 0.0) for k in slabs]
    variances = [s[f"g{k}"] / s[f"b{k}"] if learn_variances and s[f"b{k}"] > 0 else prior.variances[k] for k in slabs]
    return Prior((1 - slab, *probs), (0.0, *variances))

"""Synthetic truth: every draw is a function of the row's index and the seed alone, so results
don't depend on partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import denoise_slope
from ..functions.special import normal_cdf_udf
from .prior import Prior


def uniform(index: Column, seed: int, stream: int = 0) -> Column:
    """Uniform on (0, 1): 52 bits of a digest that any engine has."""
    digest = F.md5(F.concat_ws(":", index.cast("string"), F.lit(str(seed)), F.lit(str(stream))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def normal(index: Column, seed: int, stream: int = 0) -> Column:
    """Standard normal, by the Box-Muller transform."""
    radius = F.sqrt(-2 * F.log(uniform(index, seed, 2 * stream + 1)))
    return radius * F.cos(2 * math.pi * uniform(index, seed, 2 * stream + 2))


def mixture(spark: SparkSession, n: int, prior: Prior, seed: int = 1) -> DataFrame:
    """``idx, value``: n draws of a normal mixture; a component of variance 0 gives 0."""
    u, sd = uniform(F.col("id"), seed), F.lit(0.0)
    for p, v in reversed(list(zip(np.cumsum(prior.probs), prior.variances, strict=True))):
        sd = F.when(u <= float(p), F.lit(math.sqrt(v))).otherwise(sd)
    return spark.range(n).select(F.col("id").alias("idx"), (sd * normal(F.col("id"), seed)).alias("value"))


def sparse_effects(spark: SparkSession, n_markers: int, n_causal: int, h2: float, seed: int = 1) -> DataFrame:
    """Effects of which about ``n_causal`` are not zero and share the variance ``h2``."""
    share = n_causal / n_markers
    return mixture(spark, n_markers, Prior((1 - share, share), (0.0, h2 / n_causal)), seed)


def heavy_tailed_effects(spark: SparkSession, n_markers: int, n_causal: int, h2: float, seed: int = 1) -> DataFrame:
    """Slabs of variance v, 10 v and 100 v in the shares 1/2, 1/3 and 1/6."""
    share, v = n_causal / n_markers, 6 * h2 / (123 * n_causal)
    return mixture(spark, n_markers, Prior((1 - share, share / 2, share / 3, share / 6), (0.0, v, 10 * v, 100 * v)), seed)


def rescaled_effects(spark: SparkSession, n_markers: int, prior: Prior, h2: float, seed: int = 1) -> DataFrame:
    """A mixture whose variances are rescaled to ``h2`` over all markers."""
    total = n_markers * sum(p * v for p, v in zip(prior.probs, prior.variances, strict=True))
    return mixture(spark, n_markers, prior.scaled(h2 / total), seed)


def linear_phenotype(signal: DataFrame, h2: float, seed: int = 1) -> DataFrame:
    """``sample_idx, y``: ``sample_idx, value`` with noise of variance 1 - ``h2``."""
    noise = normal(F.col("sample_idx"), seed, 7) * math.sqrt(1 - h2)
    return signal.select("sample_idx", (F.col("value") + noise).alias("y"))


def probit_phenotype(signal: DataFrame, variance: float = 1.0, seed: int = 1) -> DataFrame:
    """``sample_idx, y`` with y = 1 at the probability of the signal's normal distribution."""
    p = normal_cdf_udf(F.col("value") / math.sqrt(variance))
    return signal.select("sample_idx", (uniform(F.col("sample_idx"), seed, 9) <= p).cast("double").alias("y"))


def alternating_covariate_effects(n: int, size: float = 0.25) -> list[float]:
    return [size if k % 2 == 0 else -size for k in range(n)]


def dense_cells(spark: SparkSession, n_samples: int, n_markers: int, seed: int = 1) -> DataFrame:
    """Independent standard normal cells."""
    cell = spark.range(n_samples * n_markers)
    return cell.select(
        (F.col("id") % n_samples).alias("sample_idx"), F.floor(F.col("id") / n_samples).cast("long").alias("marker_idx"),
        normal(F.col("id"), seed, 3).alias("value"),
    )


def state_evolution(spark: SparkSession, n: int, prior: Prior, gamma: float, before: tuple[Prior, float] | None = None, rho: float = 1.0, seed: int = 1) -> DataFrame:
    """``alpha, eta, gamma``: what the theory foretells of the effect denoiser's mean derivative and
    of the precisions after it, from ``n`` draws of the prior seen with noise of precision
    ``gamma``; the derivative is blended with that under the prior and precision ``before``."""

    def slope(own: Prior, precision: float, stream: int) -> Column:
        u, sd = uniform(F.col("id"), seed, 20 * stream), F.lit(0.0)
        for p, v in reversed(list(zip(np.cumsum(own.probs), own.variances, strict=True))):
            sd = F.when(u <= float(p), F.lit(math.sqrt(v))).otherwise(sd)
        r = sd * normal(F.col("id"), seed, 10 * stream) + normal(F.col("id"), seed, 10 * stream + 1) / math.sqrt(precision)
        return denoise_slope(r, precision, list(own.probs), list(own.variances))

    derivative = slope(prior, gamma, 1)
    if before:
        derivative = rho * derivative + (1 - rho) * slope(*before, 2)
    alpha = spark.range(n).agg(F.avg(derivative).alias("alpha"))
    return alpha.select("alpha", (gamma / F.col("alpha")).alias("eta"), (gamma / F.col("alpha") - gamma).alias("gamma"))


def variances(signal: DataFrame, pheno: DataFrame) -> DataFrame:
    """``var_signal, var_y, r2``: of ``sample_idx, value`` and ``sample_idx, y``."""
    both = signal.join(pheno, "sample_idx")
    e = F.col("y") - F.col("value")
    return both.agg(
        F.var_samp("value").alias("var_signal"), F.var_samp("y").alias("var_y"), (1 - F.sum(e * e) / (F.var_samp("y") * F.count("*"))).alias("r2")
    )


def noise_precision(snr: float, prior: Prior, n_markers: int) -> float:
    return snr / (n_markers * sum(p * v for p, v in zip(prior.probs, prior.variances, strict=True)))

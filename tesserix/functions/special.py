"""Special functions that Spark lacks: vectorised NumPy code and Arrow-batched functions on it.

Written from the mathematical definitions: the error function by its series and by Lentz's
continued fraction, Student's t by the regularised incomplete beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.frompyfunc(math.erfc, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def erfc(x) -> np.ndarray:
    return _erfc(np.asarray(x, float)).astype(float)


def erfcx(x) -> np.ndarray:
    """exp(x**2) erfc(x) without overflow: directly up to 5, by a continued fraction beyond."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.empty_like(x)
    low = x < 5
    with np.errstate(over="ignore"):
        out[low] = np.exp(x[low] ** 2) * erfc(x[low])
    t = x[~low]
    tail = np.zeros_like(t)
    for k in range(60, 0, -1):
        tail = (k / 2) / (t + tail)
    out[~low] = 1 / (math.sqrt(math.pi) * (t + tail))
    return out


def normal_cdf(x) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, float) / math.sqrt(2))


def log_normal_cdf(x) -> np.ndarray:
    """log of the normal distribution function, accurate far into the lower tail."""
    x = np.asarray(x, float)
    low = np.minimum(x, 0.0)
    tail = np.log(erfcx(-low / math.sqrt(2)) / 2) - low**2 / 2
    return np.where(x < 0, tail, np.log1p(-0.5 * erfc(np.maximum(x, 0.0) / math.sqrt(2))))


def inverse_mills(x) -> np.ndarray:
    """Normal density over distribution function."""
    return math.sqrt(2 / math.pi) / erfcx(-np.asarray(x, float) / math.sqrt(2))


def _beta_fraction(a, b, x, rounds: int = 300):
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, rounds):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised; a, b and x of one shape."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0.0, 1.0)
    gammas = (_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gammas + a * np.log(x) + b * np.log1p(-x))
    front = np.where((x == 0) | (x == 1), 0.0, front)
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    value = front * _beta_fraction(aa, bb, xx) / aa
    return np.where(swap, 1 - value, value)


def student_t_pvalue(t, df) -> np.ndarray:
    """Two-sided."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t**2))


def probit_denoise(p, tau: float, y, covariate=0.0, variance: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean of a latent score with prior N(p, 1/tau) after seeing the class y, and its
    derivative in p."""
    p, y, covariate = np.asarray(p, float), np.asarray(y, float), np.asarray(covariate, float)
    sign = 2 * y - 1
    scale = math.sqrt(variance + 1 / tau)
    c = (p + covariate) / scale
    h = inverse_mills(sign * c)
    return p + sign * h / (tau * scale), 1 - h * (sign * c + h) / (1 + tau * variance)


@F.pandas_udf(T.DoubleType())
def normal_cdf_udf(x: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def erfcx_udf(x: pd.Series) -> pd.Series:
    return pd.Series(erfcx(x.to_numpy()))


@F.pandas_udf(T.DoubleType())
def student_t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    """Null for a null statistic."""
    t, df = t.to_numpy(float), df.to_numpy(float)
    known = np.isfinite(t) & (df > 0)
    out = np.full(len(t), np.nan)
    out[known] = student_t_pvalue(t[known], df[known])
    return pd.Series(out).where(known, None)


def probit_denoise_udf(tau: float, variance: float = 1.0):
    """A function of (p, y, covariate term) that returns the struct (z1, dz1)."""

    @F.pandas_udf("z1 double, dz1 double")
    def run(p: pd.Series, y: pd.Series, m: pd.Series) -> pd.DataFrame:
        value, slope = probit_denoise(p.to_numpy(), tau, y.to_numpy(), m.to_numpy(), variance)
        return pd.DataFrame({"z1": value, "dz1": slope})

    return run

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserix.functions import scalars, special
from tesserix.operators import markers, models
from tesserix.operators.prior import Prior, default_prior

PRIOR = Prior((0.7, 0.2, 0.1), (0.0, 0.5, 4.0))
#: r, posterior mean and derivative at gamma 2.
GOLDEN = [(-3.0, -2.518445, 1.191040), (0.0, 0.0, 0.114707), (0.5, 0.064936, 0.161884), (2.0, 1.071293, 1.491117)]


def test_mixture_denoiser(spark):
    rows = spark.createDataFrame([(r,) for r, _, _ in GOLDEN], "r double")
    p, v = list(PRIOR.probs), list(PRIOR.variances)
    got = rows.select("r", scalars.denoise(F.col("r"), 2.0, p, v), scalars.denoise_slope(F.col("r"), 2.0, p, v)).collect()
    assert [pytest.approx(tuple(g), abs=2e-6) for g in got] == GOLDEN
    r = np.array([g[0] for g in GOLDEN])
    x, d = markers.denoise(r, 2.0, PRIOR)
    assert x == pytest.approx([g[1] for g in GOLDEN], abs=2e-6)
    h = 1e-5
    slope = (markers.denoise(r + h, 2.0, PRIOR)[0] - markers.denoise(r - h, 2.0, PRIOR)[0]) / (2 * h)
    assert d == pytest.approx(slope, abs=1e-6)


def test_no_noise_is_the_identity(spark):
    x, d = markers.denoise(np.array([1.0, -2.0]), 1e11, PRIOR)
    assert x.tolist() == [1.0, -2.0] and d.tolist() == [1.0, 1.0]


def test_huber(spark):
    ps = [-1.0, 0.5, 0.9, 3.0]
    rows = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in rows.select(scalars.huber_prox(F.col("p"), 2.0, 0.5, F.lit(1.0))).collect()]
    assert got == pytest.approx([-0.75, 0.666667, 0.933333, 2.75], abs=1e-6)
    assert models.huber_step(np.array(ps), 2.0, 0.5, np.ones(4))[0] == pytest.approx(got)
    slopes = [r[0] for r in rows.select(scalars.huber_prox_slope(F.col("p"), 2.0, 0.5, F.lit(1.0))).collect()]
    h = 1e-6
    up, down = (models.huber_step(np.array(ps) + s, 2.0, 0.5, np.ones(4))[0] for s in (h, -h))
    assert slopes == pytest.approx(((up - down) / (2 * h)).tolist(), abs=1e-6)


def test_probit_denoiser():
    value, slope = special.probit_denoise([0.3, 0.3], 2.0, [1, 0], 0.1)
    assert value == pytest.approx([0.545868, -0.115093], abs=1e-6)
    assert slope == pytest.approx([0.813533, 0.766087], abs=1e-6)


def test_special_functions():
    x = np.array([-3.0, 0.0, 1.0, 4.99, 5.01, 20.0])
    assert special.erfcx(x)[:4] == pytest.approx([math.exp(v * v) * math.erfc(v) for v in x[:4]])
    assert special.erfcx([5.01])[0] == pytest.approx(special.erfcx([4.99999])[0], rel=5e-3)
    assert special.erfcx([1e4])[0] == pytest.approx(1 / (math.sqrt(math.pi) * 1e4), rel=1e-6)
    assert special.log_normal_cdf([-40.0])[0] == pytest.approx(-804.608442, abs=1e-5)
    # two-sided 5% points of Student's t
    assert special.student_t_pvalue([12.706205, 2.228139, 1.959964], [1, 10, 1e7]) == pytest.approx([0.05] * 3, rel=1e-5)


def test_chromosomes(spark):
    rows = spark.createDataFrame([("1",), ("X",), ("MT",), ("22",)], "t string")
    assert [r[0] for r in rows.select(scalars.chromosome_number(F.col("t"))).collect()] == [1, 23, 0, 22]


def test_prior():
    assert Prior((0.5, 0.3, 0.2), (0.0, 1.0, 1.2)).merged() == Prior((0.5, 0.5), (0.0, 1.0))
    assert Prior((0.5, 0.3, 0.2), (0.0, 1.0, 9.0)).merged() == Prior((0.5, 0.3, 0.2), (0.0, 1.0, 9.0))
    with pytest.raises(ValueError):
        Prior((1.0,), (0.5,))
    with pytest.raises(ValueError):
        default_prior(50_000, 10)
    p = default_prior(100_000, 1000)
    assert len(p.probs) == 23 and sum(p.probs) == pytest.approx(1) and p.variances[1] == pytest.approx(1e-8)

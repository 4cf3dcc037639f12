"""Sparse Bayesian regression by vector approximate message passing.

Three likelihoods share the loop: an effect denoiser under a spike-and-slab prior alternates with
a linear (LMMSE) step over the matrix; precisions are re-estimated on the way and the prior is
learnt by expectation maximisation.  Products with the matrix run on the cluster.  Vectors of markers are
on the driver up to a number of them, and columns of a table beyond (see
:mod:`tesserix.operators.markers`); the loops are the same.

Effects are reported on the scale of standardised cells: the loop's x over sqrt(N).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import inverse_mills, log_normal_cdf, probit_denoise
from .commits import Commits
from .evaluate import expected_huber_loss
from .markers import DRIVER_MARKERS, ClusterMarkers, DriverMarkers, as_array, as_table, markers
from .matrix import MarkerMatrix
from .prior import Prior, from_sums

LEAST, MOST = 1e-11, 1e11


def clamp(x: float) -> float:
    return float(min(max(x, LEAST), MOST))


def learn_prior(vectors: DriverMarkers | ClusterMarkers, r: str, gamma: float, prior: Prior, o: "Options") -> Prior:
    """Expectation maximisation until the prior stands still, then close components merged."""
    for _ in range(o.em_rounds):
        new = from_sums(vectors.em_sums(r, gamma, prior), prior, o.learn_variances)
        change = [
            np.linalg.norm(np.subtract(a, b)) / max(np.linalg.norm(b), 1e-300)
            for a, b in ((new.probs, prior.probs), (new.variances, prior.variances))
        ]
        prior = new
        if max(change) < o.em_tolerance:
            break
    return prior.merged()


class Denoiser(Protocol):
    """What users may put in the prior's place."""

    def __call__(self, r: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
        """Effects seen with noise of precision ``gamma`` as ``r``: estimates, and their derivatives."""


@dataclass
class Options:
    model: str = "linear"
    iterations: int = 1
    rho: float = 0.15
    h2: float | None = None
    gam1: float | None = None
    gamw: float | None = None
    em_rounds: int = 2
    em_tolerance: float = 1e-2
    cg_rounds: int = 60
    stop: float = 1e-4
    learn_variances: bool = True
    by_samples: bool = False
    lmmse_damping: bool = False
    #: Share of the samples, the last ones, that is held out to choose the damping by (linear model).
    hold_out: float = 0.0
    #: Each LMMSE step solves over another tenth of the samples (linear model).
    reduced: bool = False
    #: Whether LMMSE steps are solved by way of A'A; told by the number of markers if not given.
    gram: bool | None = None
    probit_variance: float = 1.0
    #: Whether the probit model's noise variance is learnt from its latent values, from the second iteration on.
    learn_probit_variance: bool = False
    delta: float = 1e-3
    learn_delta: bool = False
    seed: int = 1


@dataclass
class Fit:
    """``trace``: (it, name, value) rows.  With vectors on the driver ``effects`` are the last
    iteration's and ``estimates`` and ``r1`` each iteration's; on the cluster these are empty and
    ``series`` is the table they are in.  :meth:`table` has them either way."""

    effects: np.ndarray | None
    prior: Prior
    estimates: list[np.ndarray] = field(default_factory=list)
    r1: list[np.ndarray] = field(default_factory=list)
    trace: list[tuple[int, str, float]] = field(default_factory=list)
    covariate_effects: np.ndarray | None = None
    series: DataFrame | None = None
    #: The number of the first iteration here; later than 1 where a fit went on from a commit.
    first: int = 1

    def table(self, spark: SparkSession) -> DataFrame:
        """``it, marker_idx, beta, r1``."""
        if self.series is not None:
            return self.series
        n = [len(x) for x in self.estimates]
        return spark.createDataFrame(
            pa.table({
                "it": np.repeat(np.arange(self.first, self.first + len(n), dtype=np.int32), n), "marker_idx": np.concatenate([np.arange(k) for k in n]),
                "beta": np.concatenate(self.estimates), "r1": np.concatenate(self.r1),
            })
        )


def fit(matrix: MarkerMatrix, y: np.ndarray, prior: Prior, options: Options | None = None, covariates: np.ndarray | None = None,
        frozen=None, start=None, r1=None, truth=None, denoiser: Denoiser | None = None, on_cluster: bool | None = None,
        commits: str | None = None) -> Fit:
    """``y``: one value a sample, NaN where missing (0 or 1 for ``bin_class``).  ``start`` and
    ``r1``: effects and r1 of an earlier fit, on the reported scale.  ``frozen``: markers that
    neither damping nor the mean derivative takes in.  ``truth``: true effects, to which the trace
    tells the cosine and the relative error of each iteration.  ``covariates``: samples by covariates, or a
    table of ``sample_idx, z``.  The other four are arrays or tables of
    ``marker_idx, value``.  ``denoiser`` takes the place of the prior's, which isn't learnt then.
    ``on_cluster``: where vectors of markers are, told by their length if not given.  ``commits``: a
    folder to which each iteration's state is committed, and from whose last commit a fit of the same
    data and options (but for ``iterations``, the number of all) goes on."""
    options = options or Options()
    y = np.where(np.isnan(y), 0.0, y)
    if (options.hold_out or options.reduced) and options.model != "linear":
        raise ValueError("only the linear model holds samples out or solves over parts of them")
    held = None
    if options.hold_out:
        # in fours, as packed payloads have them
        cut = 4 * int((1 - options.hold_out) * (matrix.n_samples // 4))
        if not 0 < cut < matrix.n_samples:
            raise ValueError(f"holding out {options.hold_out} of {matrix.n_samples} samples leaves none on one side")
        if isinstance(matrix, MarkerMatrix) and (on_cluster or matrix.n_markers > DRIVER_MARKERS):
            matrix.partition_by_marker()
        held = _HeldOut(matrix.sample_range(cut, matrix.n_samples), y[cut:], cut)
        matrix, y = matrix.sample_range(0, cut), y[:cut]
    prior = prior.scaled(matrix.n_samples)
    vectors = markers(matrix, frozen, on_cluster, False if options.reduced else options.gram)
    spread = isinstance(vectors, ClusterMarkers)
    told = lambda v: as_table(matrix.spark, v) if spread else as_array(v, matrix.n_markers)
    vectors.put("r1", told(r1) if options.model == "linear" else None)
    vectors.put("start", told(start))
    vectors.combine("r1", {"r1": np.sqrt(matrix.n_samples)})
    vectors.combine("start", {"start": np.sqrt(matrix.n_samples)})
    vectors.put("x1", None)
    vectors.put("x2", None)
    kept = Commits(commits) if commits else None
    state = kept.last() if kept else None
    if state:
        vectors.load(state["vectors"])
        prior = Prior(*map(tuple, state["scalars"]["prior"]))
    loop = _Loop(options, kept, state)
    if options.model == "linear":
        out = _linear(matrix, vectors, y, prior, options, start is not None, denoiser, held, loop)
    elif options.model in ("bin_class", "robust"):
        out = _generalised(matrix, vectors, y, prior, options, covariates, start is not None, denoiser, loop)
    else:
        raise ValueError(f"no model {options.model}")
    if spread:
        out.series = matrix.spark.read.parquet(vectors.series).select(F.col("it").cast("int"), "marker_idx", "beta", "r1")
    else:
        out.estimates, out.r1, out.effects = vectors.estimates, vectors.r1, vectors.vectors["x1"] / np.sqrt(matrix.n_samples)
    out.first = loop.first
    if truth is not None:
        out.trace += _against_truth(out, matrix, told(truth))
    return out


def _against_truth(out: Fit, matrix: MarkerMatrix, truth) -> list[tuple[int, str, float]]:
    rows = []
    if out.series is not None:
        both = out.series.join(truth.select("marker_idx", F.col("value").alias("true")), "marker_idx", "left").fillna(0.0, ["true"])
        sums = both.groupBy("it").agg(F.sum(F.col("beta") * F.col("true")).alias("xt"), F.sum(F.col("beta") ** 2).alias("xx"), F.sum(F.col("true") ** 2).alias("tt"), F.sum((F.col("beta") - F.col("true")) ** 2).alias("e"))
        found = [(r["it"], r["xt"], r["xx"], r["tt"], r["e"]) for r in sums.orderBy("it").collect()]
    else:
        found = [(it, float(x @ truth), float(x @ x), float(truth @ truth), float(((x - truth) ** 2).sum())) for it, x in enumerate(out.estimates, start=out.first)]
    for it, xt, xx, tt, e in found:
        size = max(math.sqrt(tt), 1e-300)
        rows += [(it, "cosine_to_truth", xt / max(math.sqrt(xx) * size, 1e-300)), (it, "l2_error_to_truth", math.sqrt(e) / size)]
    return rows


def _denoise_step(v, gamma: float, it: int, prior: Prior, o: Options, inner: int, denoiser) -> tuple[float, float, float, Prior]:
    """Sets x1; mean derivative, precision, and gamma1 and the prior re-estimated."""
    for _ in range(1 + inner):
        alpha, error = v.denoise("x1", "r1", gamma, prior, denoiser)
        eta = gamma / alpha
        if it < 2:
            break
        new = clamp(1 / (1 / eta + error))
        prior = prior if denoiser else learn_prior(v, "r1", new, prior, o)
        done, gamma = abs(new - gamma) < 1e-3, new
        if done:
            break
    return alpha, eta, gamma, prior


class _Loop:
    """The iterations of a fit that are left, and what they commit."""

    def __init__(self, o: Options, commits: Commits | None, state: dict | None):
        self.commits, self.scalars, self.arrays = commits, (state or {}).get("scalars", {}), (state or {}).get("arrays", {})
        self.first = 1 + (state["it"] if state else 0)
        self.left = range(self.first, 1 if self.scalars.get("done") else o.iterations + 1)

    def end(self, it: int, v, done: bool, prior: Prior, scalars: dict, arrays: dict | None = None) -> bool:
        """Commit an iteration; whether it was the last."""
        if self.commits:
            self.commits.save(it, scalars | {"done": done, "prior": [prior.probs, prior.variances]}, v, arrays or {})
        return done


class _HeldOut:
    """Samples that aren't learnt from, and how well they were predicted last."""

    #: Share of the last try's damping that the next one takes, and the most tries.
    LESS, TRIES = 0.9, 25

    def __init__(self, matrix, y: np.ndarray, n_fitted: int):
        self.matrix, self.y, self.r2 = matrix, y, -np.inf
        # x is on the scale of the samples fitted
        self.scale = np.sqrt(matrix.n_samples / n_fitted)
        self.total = max(float(((y - y.mean()) ** 2).sum()), 1e-300)

    def damping(self, v, rho: float, first: bool) -> float:
        """The largest of ``rho`` and its parts at which the estimates between "before" (0) and x1
        (1) predict no worse than the last ones did; 0, at which they stay, if none does.

        Predictions are linear in it, so two products do for all tries.
        """
        both = v.times("x1", "moved", matrix=self.matrix) * self.scale
        share = 1.0 if first else rho
        for _ in range(1 if first else self.TRIES):
            error = self.y - both[:, 0] + (1 - share) * both[:, 1]
            r2 = 1 - float(error @ error) / self.total
            if first or r2 >= self.r2:
                self.r2 = r2
                return share
            share *= self.LESS
        return 0.0


def _first_half(v, it: int, gamma: float, alpha_before: float, rho: float, prior: Prior, o: Options, started: bool, inner: int, denoiser, scale: float, held=None):
    """Denoising and damping, with the estimates kept: what all models begin an iteration with."""
    v.combine("before", {"x1": 1.0})
    v.settle("r1", "start", "x2", "before")
    alpha, eta, gamma, prior = _denoise_step(v, gamma, it, prior, o, inner, denoiser)
    if it == 1 and started:
        v.combine("x1", {"start": 1.0})
        v.combine("r1", {"start": 1.0})
    if held is not None:
        v.moved("moved", "x1", "before")
        v.settle("r1", "x1", "x2", "start", "before", "moved")
        rho = held.damping(v, rho, it == 1)
    if it > 1:
        v.damp("x1", "before", rho)
        alpha = rho * alpha + (1 - rho) * alpha_before
    v.settle("r1", "x1", "x2", "start", "before")
    v.keep(it, scale)
    return alpha, eta, gamma, prior


def _stands(v, it: int, o: Options) -> bool:
    """Whether estimates moved by less than ``o.stop`` of their size."""
    moved, size = v.squares(("x1", "before"), ("before", None))
    return it > 1 and size > 0 and math.sqrt(moved / size) < o.stop


def _tenth(matrix, y: np.ndarray, seed: int):
    """A tenth of the samples, in a row and in fours, and their phenotypes."""
    fours = matrix.n_samples // 4
    length = max(1, fours // 10)
    start = int(np.random.default_rng(seed).integers(0, max(1, fours - length + 1)))
    return matrix.sample_range(4 * start, 4 * (start + length)), y[4 * start : 4 * (start + length)]


def _linear(matrix: MarkerMatrix, v, y, prior, o: Options, started: bool, denoiser, held, loop: _Loop) -> Fit:
    n, m, scale = matrix.n_samples, matrix.n_markers, 1 / np.sqrt(matrix.n_samples)
    gam1 = o.gam1 or 1e-6
    gamw = o.gamw or (1 / (1 - o.h2) if o.h2 is not None and 0 <= o.h2 < 1 else 2.0)
    rho, alpha1, alpha2, gam2, u = o.rho, 0.0, 0.0, None, loop.arrays.get("u")
    if loop.scalars:
        gam1, gamw, rho, alpha1, alpha2, gam2 = (loop.scalars[k] for k in ("gam1", "gamw", "rho", "alpha1", "alpha2", "gam2"))
        if held is not None:
            held.r2 = loop.scalars["held"]
    out = Fit(None, prior)
    note = lambda it, **v: out.trace.extend((it, k, float(x)) for k, x in v.items())
    for it in loop.left:
        alpha1, eta1, gam1, prior = _first_half(v, it, gam1, alpha1, rho, prior, o, started, 5, denoiser, scale, held)
        if held is not None:
            note(it, r2_held_out=held.r2)
        z1 = v.times("x1")[:, 0]
        new = clamp(eta1 - gam1)
        gam2 = rho * new + (1 - rho) * gam2 if o.lmmse_damping and gam2 is not None else new
        v.combine("r2", {"x1": eta1 / gam2, "r1": -gam1 / gam2})
        rho = max(rho, min(2 * min(alpha1, alpha2), 1.0))
        if it == 1 and not denoiser:
            prior = learn_prior(v, "r1", gam1, prior, o)
        note(it, alpha1=alpha1, gam1=gam1, gam2=gam2, r2_x1=_r2(y, z1))
        part, own = _tenth(matrix, y, o.seed + it) if o.reduced else (matrix, y)
        v.matrix = part
        if o.by_samples:
            alpha2, u = v.lmmse_by_samples("x2", gamw, gam2, own, "r2", None if o.reduced else u, o.cg_rounds, o.seed)
        else:
            alpha2 = v.lmmse("x2", gamw, gam2, own, "r2", "x2" if it > 1 else None, o.cg_rounds, o.seed)
        eta2 = gam2 / alpha2
        if it > 2:
            gam2 = clamp(1 / (1 / eta2 + v.squares(("x2", "r2"))[0] / m))
        gam1 = clamp(eta2 - gam2)
        v.combine("r1", {"x2": eta2 / gam1, "r2": -gam2 / gam1})
        correction = v.times("solved", "probe")
        v.matrix = matrix
        z2 = v.times("x2")[:, 0]
        gamw = n / (float(((z2 - y) ** 2).sum()) + m * float(correction[:, 1] @ correction[:, 0]))
        note(it, r2_x2=_r2(y, z2), gamw=gamw, rho=rho, components=len(prior.probs))
        scalars = {"gam1": gam1, "gamw": gamw, "rho": rho, "alpha1": alpha1, "alpha2": alpha2, "gam2": gam2, "held": held and held.r2}
        if loop.end(it, v, _stands(v, it, o), prior, scalars, {"u": u}):
            break
    out.prior = prior
    return out


def _r2(y: np.ndarray, z: np.ndarray) -> float:
    return 1 - float(((y - z) ** 2).sum() / max((y**2).sum(), 1e-300))


def probit_covariates(y: np.ndarray, z: np.ndarray, variance: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Effects of the covariates in a probit regression, by Newton's method with halving."""
    eta, sign = np.zeros(z.shape[1]), 2 * y - 1
    scale = np.sqrt(variance)
    loss = lambda e: -float(log_normal_cdf(sign * (z @ e) / scale).mean())
    for _ in range(rounds):
        c = sign * (z @ eta) / scale
        h = inverse_mills(c)
        gradient = -(z * (sign * h)[:, None]).mean(axis=0) / scale
        hessian = (z * (h * (c + h))[:, None]).T @ z / len(y) / variance
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        now, size = loss(eta), 1.0
        while loss(eta - size * step) > now and size > 1e-8:
            size *= 0.5
        eta = eta - size * step
        if np.linalg.norm(size * step) <= 1e-10 * (1 + np.linalg.norm(eta)):
            break
    return eta


def covariate_offset(covariates: DataFrame, effects, n: int) -> np.ndarray:
    """z'effects of each sample of ``sample_idx, z``; only the products, a number a sample, reach the driver."""
    terms = [F.col("z")[c] * float(e) for c, e in enumerate(effects)]
    rows = covariates.select("sample_idx", sum(terms[1:], terms[0]).alias("value")).toArrow()
    out = np.zeros(n)
    out[rows["sample_idx"].to_numpy()] = rows["value"].to_numpy()
    return out


def probit_covariates_of(table: DataFrame, n_covariates: int, variance: float = 1.0, rounds: int = 100) -> np.ndarray:
    """The same of a table (``z``, an array, and ``y``): each step's loss, gradient and Hessian are
    sums that the cluster adds up, of 1 + C + C * C numbers."""
    scale, size = np.sqrt(variance), n_covariates

    def sums(eta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def run(batches):
            total = np.zeros(2 + size + size * size)
            for batch in batches:
                z = batch.column("z").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                sign = 2 * batch.column("y").to_numpy(zero_copy_only=False) - 1
                c = sign * (z @ eta) / scale
                h = inverse_mills(c)
                gradient = -(z * (sign * h)[:, None]).sum(axis=0) / scale
                hessian = (z * (h * (c + h))[:, None]).T @ z / variance
                total += np.concatenate([[len(z), -log_normal_cdf(c).sum()], gradient, hessian.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

        known = table.select("z", F.col("y").cast("double").alias("y")).where("y IS NOT NULL AND z IS NOT NULL")
        added = np.zeros(2 + size + size * size)
        for row in known.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
            added[row["at"]] = row["value"]
        mean = added[1:] / max(added[0], 1)
        return mean[0], mean[1 : 1 + size], mean[1 + size :].reshape(size, size)

    eta = np.zeros(size)
    now, gradient, hessian = sums(eta)
    for _ in range(rounds):
        step, share = np.linalg.lstsq(hessian, gradient, rcond=None)[0], 1.0
        tried = sums(eta - step)
        while tried[0] > now and share > 1e-8:
            share *= 0.5
            tried = sums(eta - share * step)
        eta = eta - share * step
        now, gradient, hessian = tried
        if np.linalg.norm(share * step) <= 1e-10 * (1 + np.linalg.norm(eta)):
            break
    return eta


def _variance_scores(z: np.ndarray, y: np.ndarray, variances: np.ndarray, eta: float | None, nodes: int = 24) -> np.ndarray:
    """Sums over rows of the slope of E log Phi((2y - 1) z / sqrt(v)) in log v, over z with precision
    ``eta`` around what is given (or just that), at each v."""
    at, weight = (np.zeros(1), np.ones(1)) if eta is None else np.polynomial.hermite_e.hermegauss(nodes)
    sign, out = 2 * y - 1, np.zeros(len(variances))
    for a, w in zip(at, weight / weight.sum(), strict=True):
        drawn = sign * (z if eta is None else z + a / np.sqrt(eta))
        for k, v in enumerate(variances):
            c = drawn / np.sqrt(v)
            out[k] += w * float((-c * inverse_mills(c)).sum()) / 2
    return out


def probit_variance(points, eta: float | None = None, low: float = 1e-4, high: float = 1e4, trials: int = 8, rounds: int = 8) -> float:
    """The noise variance at which the expected likelihood of ``y`` given ``z`` has no slope.

    ``points``: a table of ``z, y``, or two arrays.  The slope falls through zero, so each round brackets
    that among ``trials`` values, all in one aggregate, and the last bracket's middle (on a log scale) is
    the answer; one of the bounds, if the slope has one sign between them.
    """

    def scores(variances: np.ndarray) -> np.ndarray:
        if not isinstance(points, DataFrame):
            return _variance_scores(*points, variances, eta)

        def run(batches):
            total = np.zeros(len(variances))
            for batch in batches:
                total += _variance_scores(batch.column("z").to_numpy(), batch.column("y").to_numpy(), variances, eta)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "value"])

        known = points.select(F.col("z").cast("double"), F.col("y").cast("double")).where("z IS NOT NULL AND y IS NOT NULL")
        out = np.zeros(len(variances))
        for row in known.mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).collect():
            out[row["k"]] = row["value"]
        return out

    for _ in range(rounds):
        tried = np.exp(np.linspace(np.log(low), np.log(high), trials + 2))
        up = scores(tried) > 0
        if up[-1]:
            return high
        if not up[0]:
            return low
        k = int(np.flatnonzero(up)[-1])
        low, high = float(tried[k]), float(tried[k + 1])
    return float(np.sqrt(low * high))


#: Thresholds of the Huber loss that are compared when it is learnt (fixed values).
DELTAS = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2, 1e-1, 0.2, 0.4, 0.6, 0.8, 1, 1.5, 2, 3)


def huber_step(p: np.ndarray, tau: float, delta: float, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, step = y - p, 1 / tau
    inside = np.abs(w) <= (1 + step) * delta
    residual = np.where(inside, w / (1 + step), w - np.sign(w) * delta * step)
    return y - residual, np.where(inside, 1 / (1 + step), 1.0)


def huber_delta(p: np.ndarray, tau: float, y: np.ndarray, seed: int = 1, draws: int = 100, spark: SparkSession | None = None) -> float:
    """The threshold with the least mean loss over z ~ N(p, 1/tau); the mean loss rises with
    the threshold, so this is the least of the grid up to sampling noise.  With a session, draws are
    made and averaged on the cluster."""
    if spark is not None:
        points = spark.createDataFrame(pa.table({"idx": np.arange(len(p)), "p": p, "y": y}))
        return min((r["loss"], r["delta"]) for r in expected_huber_loss(points, tau, list(DELTAS), draws, seed).collect())[1]
    rng, loss = np.random.default_rng(seed), np.zeros(len(DELTAS))
    for _ in range(draws):
        w = np.abs(y - p - rng.normal(0, 1 / np.sqrt(tau), len(p)))
        loss += [np.where(w <= d, w * w / 2, d * (w - d / 2)).sum() for d in DELTAS]
    return DELTAS[int(np.argmin(loss))]


def _generalised(matrix: MarkerMatrix, v, y, prior, o: Options, covariates, started: bool, denoiser, loop: _Loop) -> Fit:
    """Probit (``bin_class``) and Huber (``robust``) likelihoods."""
    n, m, scale = matrix.n_samples, matrix.n_markers, 1 / np.sqrt(matrix.n_samples)
    probit, here = o.model == "bin_class", matrix.present
    gam1 = o.gam1 or 1e-8
    tau1, delta = gam1, o.delta
    p1 = np.random.default_rng(o.seed).normal(size=n) if probit else np.zeros(n)
    eta, offset = None, np.zeros(n)
    if probit and isinstance(covariates, DataFrame):
        known = matrix.spark.createDataFrame(pa.table({"sample_idx": np.flatnonzero(here), "y": y[here]}))
        width = len(covariates.first()["z"])
        eta = probit_covariates_of(covariates.join(known, "sample_idx"), width, o.probit_variance)
        offset = covariate_offset(covariates, eta, n)
    elif probit and covariates is not None:
        eta = probit_covariates(y[here], covariates[here], o.probit_variance)
        offset = covariates @ eta
    rho, alpha1, variance = o.rho, 0.0, o.probit_variance
    if loop.scalars:
        gam1, tau1, delta, alpha1, variance = (loop.scalars[k] for k in ("gam1", "tau1", "delta", "alpha1", "variance"))
        p1 = loop.arrays["p1"]
    out = Fit(None, prior, covariate_effects=eta)
    note = lambda it, **v: out.trace.extend((it, k, float(x)) for k, x in v.items())
    for it in loop.left:
        alpha1, eta1, gam1, prior = _first_half(v, it, gam1, alpha1, rho, prior, o, started, 50, denoiser, scale)
        gam2 = clamp(eta1 - gam1)
        v.combine("r2", {"x1": eta1 / gam2, "r1": -gam1 / gam2})
        for _ in range(50 if it > 1 else 1):
            if probit:
                z1, slope = probit_denoise(p1, tau1, y, offset, variance)
            else:
                z1, slope = huber_step(p1, tau1, delta, y)
            beta1 = float(np.clip(slope[here].mean(), 1e-8, 1 - 1e-8))
            if it == 1:
                break
            new = clamp(1 / (beta1 / tau1 + float(((z1 - p1)[here] ** 2).mean())))
            done, tau1 = abs(new - tau1) < 1e-3 * tau1, new
            if done:
                break
        if probit and o.learn_probit_variance and it > 1:
            points = (z1[here] + offset[here], y[here])
            spark = getattr(matrix, "spark", None)
            variance = probit_variance(points if spark is None else spark.createDataFrame(pa.table({"z": points[0], "y": points[1]})), tau1 / beta1)
            note(it, probit_variance=variance)
        if not probit and o.learn_delta:
            delta = huber_delta(p1[here], tau1, y[here], o.seed + it, spark=getattr(matrix, "spark", None))
        p2 = np.where(here, (z1 - beta1 * p1) / (1 - beta1), 0.0)
        tau2 = clamp(tau1 * (1 - beta1) / beta1)
        alpha2 = float(np.clip(v.lmmse("x2", tau2, gam2, p2, "r2", None, o.cg_rounds, o.seed), 1e-8, 1 - 1e-8))
        gam2 = clamp(1 / (alpha2 / gam2 + v.squares(("x2", "r2"))[0] / m)) if it > 1 else gam2
        v.combine("r1", {"x2": 1 / (1 - alpha2), "r2": -alpha2 / (1 - alpha2)})
        gam1 = clamp(gam2 * (1 - alpha2) / alpha2)
        z2 = v.times("x2")[:, 0]
        beta2 = float(np.clip(m / n * (1 - alpha2), 1e-8, 1 - 1e-8))
        if it > 1:
            tau2 = clamp(1 / (beta2 / tau2 + float(((z2 - p2)[here] ** 2).mean())))
        p1 = (z2 - beta2 * p2) / (1 - beta2)
        tau1 = clamp(tau2 * (1 - beta2) / beta2)
        note(it, gam1=gam1, gam2=gam2, tau1=tau1, tau2=tau2, alpha2=alpha2, delta=delta, components=len(prior.probs))
        scalars = {"gam1": gam1, "tau1": tau1, "delta": delta, "alpha1": alpha1, "variance": variance}
        if loop.end(it, v, _stands(v, it, o), prior, scalars, {"p1": p1}):
            break
    out.prior = prior
    return out

"""Vectors over markers, as the models' loops use them: on the driver or on the cluster.

Both classes hold vectors by name and have the same methods, so a loop is written once.  On the
driver a vector is a NumPy array.  On the cluster the vectors are columns of one table: combining
and denoising them is Column expressions, sums and dot products are aggregates, and products with
the matrix join the table with the packed markers, which are partitioned by marker once and stay
where they are; only the table's columns are shuffled to them.  What reaches the driver are scalars
and vectors of samples.

A table on the cluster is written to the shared folder after each step that needs it whole, which
cuts its lineage, and the one before is deleted.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import scalars
from . import solvers
from .matrix import MarkerMatrix, standardised_slices
from .prior import Prior, em_sums

#: Markers up to which a fit's vectors are on the driver: some dozens of vectors of this length.
DRIVER_MARKERS = 1 << 20


def weights(r: np.ndarray, gamma: float, prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    s = np.array(prior.variances) + 1 / gamma
    e = -0.5 * r[:, None] ** 2 * (1 / s - 1 / s.max())
    return np.array(prior.probs) / np.sqrt(s) * np.exp(e), s


def denoise(r: np.ndarray, gamma: float, prior: Prior) -> tuple[np.ndarray, np.ndarray]:
    """Posterior means and their derivatives; as the Column expressions have them."""
    if abs(1 / gamma) < 1e-10:
        return r.copy(), np.ones_like(r)
    w, s = weights(r, gamma, prior)
    total, once, twice = w.sum(axis=1), (w / s).sum(axis=1), (w / s**2).sum(axis=1)
    mean = r * once / total
    return r - mean / gamma, 1 + ((r * r * twice - once) / total - mean**2) / gamma


class DriverMarkers:
    """Vectors as arrays."""

    def __init__(self, matrix, frozen: np.ndarray | None = None, gram: bool = False):
        """``gram``: solve by way of A'A, put together once for each matrix."""
        self.matrix, self.n = matrix, matrix.n_markers
        self.gram: solvers.Gram | None = None
        self.by_gram = gram
        self.live = np.ones(self.n, bool) if frozen is None else ~np.asarray(frozen, bool)
        self.vectors: dict[str, np.ndarray] = {}
        self.estimates: list[np.ndarray] = []
        self.r1: list[np.ndarray] = []

    def put(self, name: str, values: np.ndarray | None) -> None:
        """Zeros, if there are no values."""
        self.vectors[name] = np.zeros(self.n) if values is None else np.array(values, float)

    def combine(self, name: str, terms: dict[str, float]) -> None:
        self.vectors[name] = sum(c * self.vectors[v] for v, c in terms.items())

    def damp(self, name: str, before: str, rho: float) -> None:
        """Between two vectors, but for frozen markers."""
        v = self.vectors
        v[name] = np.where(self.live, rho * v[name] + (1 - rho) * v[before], v[name])

    def moved(self, name: str, a: str, b: str) -> None:
        """a - b, and 0 for frozen markers."""
        self.vectors[name] = np.where(self.live, self.vectors[a] - self.vectors[b], 0.0)

    def denoise(self, name: str, r: str, gamma: float, prior: Prior, denoiser) -> tuple[float, float]:
        """Mean derivative over the markers that aren't frozen, and mean square of what changed."""
        own = self.vectors[r]
        x, slope = denoiser(own, gamma) if denoiser else denoise(own, gamma, prior)
        self.vectors[name] = x
        return float(slope[self.live].mean()), float(((x - own) ** 2).mean())

    def em_sums(self, r: str, gamma: float, prior: Prior) -> dict[str, float]:
        own = self.vectors[r]
        w, _ = weights(own, gamma, prior)
        share = w / w.sum(axis=1, keepdims=True)
        sums = {"n": len(own), "pi": float(share[:, 1:].sum())}
        for k, v in enumerate(prior.variances[1:], start=1):
            m = own * gamma / (1 / v + gamma)
            sums[f"b{k}"] = float(share[:, k].sum())
            sums[f"g{k}"] = float((share[:, k] * (m * m + 1 / (1 / v + gamma))).sum())
        return sums

    def squares(self, *pairs: tuple[str, str | None]) -> list[float]:
        """Sums of squares of vectors, or of the difference of two."""
        v = self.vectors
        return [float(((v[a] - (v[b] if b else 0.0)) ** 2).sum()) for a, b in pairs]

    def settle(self, *names: str) -> None:
        """These vectors are all that is needed later."""
        self.vectors = {n: self.vectors[n] for n in names}

    def times(self, *names: str, matrix=None) -> np.ndarray:
        return (matrix or self.matrix).times(np.stack([self.vectors[n] for n in names], axis=1))

    def _gram(self) -> solvers.Gram:
        if self.gram is None or self.gram.matrix is not self.matrix:
            self.gram = solvers.Gram(self.matrix)
        return self.gram

    def lmmse(self, name: str, tau: float, gamma: float, target: np.ndarray, r2: str, start: str | None, rounds: int, seed: int) -> float:
        """Sets ``name``, ``probe`` and ``solved``; see :func:`tesserix.operators.solvers.lmmse`."""
        v = self.vectors
        if self.by_gram:
            v[name], alpha, v["probe"], v["solved"] = self._gram().lmmse(tau, gamma, target, v[r2], seed)
            return alpha
        begin = v[start] if start else None
        v[name], alpha, v["probe"], v["solved"] = solvers.lmmse(self.matrix, tau, gamma, target, v[r2], begin, rounds, seed)
        return alpha

    def lmmse_by_samples(self, name: str, tau: float, gamma: float, target: np.ndarray, r2: str, start, rounds: int, seed: int) -> tuple[float, np.ndarray]:
        v = self.vectors
        gram = self._gram() if self.by_gram else None
        alpha, v["probe"], v["solved"] = solvers.probe_trace(self.matrix, tau, gamma, rounds, seed, gram)
        v[name], u = solvers.lmmse_by_samples(self.matrix, tau, gamma, target, v[r2], start, rounds)
        return alpha, u

    def save(self, path: str, names: tuple[str, ...]) -> None:
        from .commits import write_arrays

        write_arrays(path, {n: self.vectors[n] for n in names})

    def load(self, path: str) -> None:
        from .commits import read_arrays

        self.vectors |= read_arrays(path)

    def keep(self, it: int, scale: float) -> None:
        """The iteration's estimates ``x1`` and its ``r1``, both by ``scale``."""
        self.estimates.append(self.vectors["x1"] * scale)
        self.r1.append(self.vectors["r1"] * scale)


def _sum(terms: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, c in terms.items():
        total = total + F.lit(float(c)) * F.col(name)
    return total


def _with_doubles(table: DataFrame, names: list[str]) -> StructType:
    return StructType([*table.schema.fields, *(StructField(n, DoubleType()) for n in names)])


class ClusterMarkers:
    """Vectors as columns of ``table``, a row a marker.  ``written`` is the table as it was last
    written, and ``series`` the folder with what was kept of each iteration."""

    def __init__(self, matrix: MarkerMatrix, frozen: DataFrame | None = None):
        """``frozen``: ``marker_idx, value``, a value over 0 for markers that are frozen."""
        from ..plans.session import shared_folder

        self.matrix, self.n, self.spark = matrix, matrix.n_markers, matrix.spark
        matrix.partition_by_marker()
        self.folder, self.step = f"{shared_folder(self.spark)}/fit-{uuid.uuid4().hex}", 0
        self.series = f"{self.folder}/series"
        table = matrix.rows.select("marker_idx")
        table = table.distinct() if matrix.n_segments > 1 else table
        if frozen is None:
            self.table = table.withColumn("live", F.lit(True))
        else:
            live = frozen.select("marker_idx", (F.col("value") <= 0).alias("live"))
            self.table = table.join(live, "marker_idx", "left").withColumn("live", F.coalesce("live", F.lit(True)))
        self.written: DataFrame | None = None
        self._write()

    def _write(self, *names: str) -> None:
        """The table, with these vectors, written and read again; the last one is deleted."""
        from ..plans.session import delete

        path, before = f"{self.folder}/{self.step}", f"{self.folder}/{self.step - 1}"
        self.table.select("marker_idx", "live", *names).write.parquet(path)
        self.table = self.written = self.spark.read.schema(self.table.select("marker_idx", "live", *names).schema).parquet(path)
        if self.step:
            delete(self.spark, before)
        self.step += 1

    def put(self, name: str, values: DataFrame | None) -> None:
        """Zeros, or the values of ``marker_idx, value``."""
        if values is None:
            self.table = self.table.withColumn(name, F.lit(0.0))
        else:
            own = values.select("marker_idx", F.col("value").cast("double").alias(name))
            self.table = self.table.drop(name).join(own, "marker_idx", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))

    def combine(self, name: str, terms: dict[str, float]) -> None:
        self.table = self.table.withColumn(name, _sum(terms))

    def damp(self, name: str, before: str, rho: float) -> None:
        mixed = scalars.damped(F.col(name), F.col(before), rho)
        self.table = self.table.withColumn(name, F.when(F.col("live"), mixed).otherwise(F.col(name)))

    def moved(self, name: str, a: str, b: str) -> None:
        self.table = self.table.withColumn(name, F.when(F.col("live"), F.col(a) - F.col(b)).otherwise(0.0))

    def denoise(self, name: str, r: str, gamma: float, prior: Prior, denoiser) -> tuple[float, float]:
        """Of the table as it was written; a user's ``denoiser`` gets Arrow batches of its rows."""
        base, slope = self.written.drop(name), f"slope of {name}"
        if denoiser:
            schema = _with_doubles(base, [name, slope])

            def run(batches):
                for batch in batches:
                    x, dx = denoiser(batch.column(r).to_numpy(zero_copy_only=False), gamma)
                    for extra, values in ((name, x), (slope, dx)):
                        batch = batch.append_column(extra, pa.array(np.asarray(values, float)))
                    yield batch

            out = base.mapInArrow(run, schema)
        else:
            own = (F.col(r), gamma, list(prior.probs), list(prior.variances))
            out = base.withColumn(name, scalars.denoise(*own)).withColumn(slope, scalars.denoise_slope(*own))
        row = out.agg(F.avg(F.when(F.col("live"), F.col(f"`{slope}`"))).alias("alpha"), F.avg((F.col(name) - F.col(r)) ** 2).alias("error")).first()
        self.table = out.drop(slope)
        return row["alpha"], row["error"]

    def em_sums(self, r: str, gamma: float, prior: Prior) -> dict[str, float]:
        return em_sums(self.written.select(F.col(r).alias("r")), gamma, prior).first().asDict()

    def squares(self, *pairs: tuple[str, str | None]) -> list[float]:
        sums = [F.sum((F.col(a) - (F.col(b) if b else 0.0)) ** 2).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
        return [float(x) for x in self.table.agg(*sums).first()]

    def settle(self, *names: str) -> None:
        self._write(*names)

    def times(self, *names: str, matrix=None) -> np.ndarray:
        return (matrix or self.matrix).times_columns(self.table.select("marker_idx", *names), names)

    def _with_transposed(self, table: DataFrame, names: list[str], u: np.ndarray) -> DataFrame:
        """``table`` with A'u in new columns, one for each column of ``u``."""
        (rows, shared, own), cut, n = self.matrix.beside(u), self.matrix._cut(), self.matrix.n_samples
        # a marker's segments are in several rows, whose sums are added
        several = self.matrix.n_segments > 1
        kept = ["marker_idx"] if several else table.columns
        schema = _with_doubles(table.select(*kept), names)

        def run(batches):
            for part, at, z, _ in standardised_slices(batches, cut, shared.value[1]):
                values = z @ own(part, at, z.shape[1]) / np.sqrt(n)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, np.ascontiguousarray(values.T))], [*kept, *names])

        if several:
            sums = rows.mapInArrow(run, schema).groupBy("marker_idx").agg(*(F.sum(c).alias(c) for c in names))
            return table.join(sums, "marker_idx")
        return rows.join(table, "marker_idx").mapInArrow(run, schema)

    def transpose_times(self, name: str, u: np.ndarray) -> None:
        """A'u / sqrt(N) of a vector of samples."""
        self.table = self._with_transposed(self.table, [name], u[:, None])

    def _with_probe(self, table: DataFrame, seed: int) -> DataFrame:
        n, schema = self.n, _with_doubles(table, ["probe"])

        def run(batches):
            for batch in batches:
                yield batch.append_column("probe", pa.array(solvers.signs(n, seed, batch.column("marker_idx").to_numpy())))

        return table.mapInArrow(run, schema)

    def conjugate_gradient(self, tau: float, gamma: float, systems: list[tuple[str, str, str | None]], rounds: int, tolerance: float = 1e-5) -> None:
        """Solves (tau A'A + gamma) x = b for (x, b, start) by name; as the solver on the driver, whose
        preconditioner is the same number for all markers.

        A round has one product each way.  Its table holds x, the residual r, the direction p and q = Qp
        with their dot products' terms, from which the next step follows, so nothing else is read.
        """
        others = [c for c in self.table.columns if c not in ("marker_idx", "live") and c not in [x for x, _, _ in systems]]
        d, k = solvers.marker_diagonal_value(self.matrix, tau, gamma), range(len(systems))
        col = lambda name, i: F.col(f"{name}_{i}")
        table = self.table
        for i, (_, _, start) in enumerate(systems):
            table = table.withColumn(f"x_{i}", F.col(start) if start else F.lit(0.0))
        table = table.select("marker_idx", "live", *others, *(f"x_{i}" for i in k))
        warm = any(start for _, _, start in systems)
        if warm:
            w = self.matrix.times_columns(table, [f"x_{i}" for i in k])
            table = self._with_transposed(table, [f"g_{i}" for i in k], w)
        for i, (_, b, _) in enumerate(systems):
            table = table.withColumn(f"r_{i}", F.col(b) - (tau * col("g", i) + gamma * col("x", i)) if warm else F.col(b))
        names = [f"{v}_{i}" for v in "xr" for i in k]
        self.table = table
        self._write(*others, *names)
        row = self.table.agg(*(F.sum(F.col(b) ** 2).alias(f"b_{i}") for i, (_, b, _) in enumerate(systems)), *(F.sum(col("r", i) ** 2).alias(f"r_{i}") for i in k)).first()
        size, rr = ([row[f"{v}_{i}"] for i in k] for v in "br")
        table, step, beta = self.table, [0.0] * len(k), [0.0] * len(k)
        for i in k:
            table = table.withColumn(f"p_{i}", F.lit(0.0)).withColumn(f"q_{i}", F.lit(0.0))
        for _ in range(rounds):
            if all(r <= tolerance**2 * b for r, b in zip(rr, size)):
                break
            for i in k:
                table = table.withColumn(f"r_{i}", col("r", i) - step[i] * col("q", i)).withColumn(f"x_{i}", col("x", i) + step[i] * col("p", i))
                table = table.withColumn(f"p_{i}", col("r", i) / d + beta[i] * col("p", i)).drop(f"q_{i}")
            w = self.matrix.times_columns(table.select("marker_idx", *(f"p_{i}" for i in k)), [f"p_{i}" for i in k])
            table = self._with_transposed(table, [f"g_{i}" for i in k], w)
            for i in k:
                table = table.withColumn(f"q_{i}", tau * col("g", i) + gamma * col("p", i))
            self.table = table
            self._write(*others, *(f"{v}_{i}" for v in "xrpq" for i in k))
            table = self.table
            sums = [F.sum(col(a, i) * col(b, i)).alias(f"{a}{b}_{i}") for a, b in ("pq", "rq", "qq", "rr") for i in k]
            row = table.agg(*sums).first()
            for i in k:
                pq, rq, qq, before = (row[f"{v}_{i}"] for v in ("pq", "rq", "qq", "rr"))
                step[i] = before / d / pq if pq > 0 else 0.0
                rr[i] = max(0.0, before - 2 * step[i] * rq + step[i] ** 2 * qq)
                beta[i] = rr[i] / before if before > 0 else 0.0
        for i, (x, _, _) in enumerate(systems):
            table = table.withColumn(x, col("x", i) + step[i] * col("p", i))
        self.table = table.select("marker_idx", "live", *others, *(x for x, _, _ in systems))

    def lmmse(self, name: str, tau: float, gamma: float, target: np.ndarray, r2: str, start: str | None, rounds: int, seed: int) -> float:
        table = self._with_probe(self._with_transposed(self.table, ["b"], target[:, None]), seed)
        self.table = table.withColumn("b", tau * F.col("b") + gamma * F.col(r2))
        self.conjugate_gradient(tau, gamma, [(name, "b", start), ("solved", "probe", None)], rounds)
        self._write(*(c for c in self.table.columns if c not in ("marker_idx", "live", "b")))
        return gamma * self.table.agg(F.sum(F.col("probe") * F.col("solved"))).first()[0]

    def lmmse_by_samples(self, name: str, tau: float, gamma: float, target: np.ndarray, r2: str, start, rounds: int, seed: int) -> tuple[float, np.ndarray]:
        self.table = self._with_probe(self.table, seed)
        self.conjugate_gradient(tau, gamma, [("solved", "probe", None)], rounds)
        apply = lambda v: tau * self.matrix.gram_times(v) + gamma * v if v.any() else np.zeros_like(v)
        b = target - self.times(r2)[:, 0]
        u, _ = solvers.conjugate_gradient(apply, b, tau * self.matrix.sample_diagonal() + gamma, start, rounds, 1e-4)
        table = self._with_transposed(self.table, ["g"], u[:, None])
        self.table = table.withColumn(name, F.col(r2) + tau * F.col("g")).drop("g")
        self._write(*(c for c in self.table.columns if c not in ("marker_idx", "live")))
        return gamma * self.table.agg(F.sum(F.col("probe") * F.col("solved"))).first()[0], u

    def save(self, path: str, names: tuple[str, ...]) -> None:
        self.table.select("marker_idx", *names).write.parquet(path)

    def load(self, path: str) -> None:
        saved = self.spark.read.parquet(path)
        self.table = self.table.drop(*(c for c in saved.columns if c != "marker_idx")).join(saved, "marker_idx")

    def keep(self, it: int, scale: float) -> None:
        kept = self.table.select("marker_idx", (F.col("x1") * scale).alias("beta"), (F.col("r1") * scale).alias("r1"))
        kept.write.parquet(f"{self.series}/it={it}")


def markers(matrix, frozen, on_cluster: bool | None, gram: bool | None = None) -> DriverMarkers | ClusterMarkers:
    """Vectors on the driver up to ``DRIVER_MARKERS`` markers, and solved for by way of A'A up to
    ``solvers.GRAM_MARKERS``, unless said otherwise."""
    packed = isinstance(matrix, MarkerMatrix)
    if on_cluster is None:
        on_cluster = packed and matrix.n_markers > DRIVER_MARKERS
    if on_cluster:
        return ClusterMarkers(matrix, as_table(matrix.spark, frozen))
    if gram is None:
        gram = packed and matrix.n_markers <= solvers.GRAM_MARKERS
    return DriverMarkers(matrix, as_array(frozen, matrix.n_markers), gram)


def as_table(spark, values) -> DataFrame | None:
    """``marker_idx, value`` of a table or an array."""
    if values is None or isinstance(values, DataFrame):
        return values
    return spark.createDataFrame(pa.table({"marker_idx": np.arange(len(values)), "value": np.asarray(values, float)}))


def as_array(values, n: int) -> np.ndarray | None:
    """The same as an array; markers that a table lacks are 0."""
    if not isinstance(values, DataFrame):
        return values
    out, table = np.zeros(n), values.select("marker_idx", F.col("value").cast("double")).toArrow()
    out[table["marker_idx"].to_numpy()] = table["value"].to_numpy()
    return out



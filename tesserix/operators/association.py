"""Association tests of every marker, leaving its own or its chromosome's effect in.

The residual of a test adds the tested effects back: e + z x / sqrt(N) for one marker, or the sum
of those of a chromosome.  Leave-one-out sums follow algebraically from the sums with the plain
residual, so one pass and one shuffle serve all markers; leave-one-chromosome-out takes one
shuffle for the chromosomes' predictors and one for the sums.

The same tests run straight on packed markers, all estimates in one scan: a narrow map with the
residuals broadcast, after a sum of partial predictors by chromosome.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import student_t_pvalue_udf
from .cells import t_statistic
from .matrix import MarkerMatrix

#: Bytes of chromosomes' predictors that are broadcast at a time; more estimates take more scans.
PREDICTOR_BYTES = 256 << 20


def marginal(sums: DataFrame) -> DataFrame:
    """``marker_idx, n, t, p`` of the simple regressions whose sums are given."""
    return sums.select("marker_idx", "n", t_statistic().alias("t")).withColumn("p", student_t_pvalue_udf("t", F.col("n") - 2.0))


def leave_one_out(z: DataFrame, residual: DataFrame, x: DataFrame, n_samples: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``marker_idx, n, t``: each marker's test with its own effect left in the residual.

    ``z``: standardised cells with ``value``; ``residual``: ``sample_idx, e`` of the present
    samples; ``x``: ``marker_idx, x``.  ``keys`` (such as an iteration or an estimate) are
    further columns of ``residual`` and ``x``: all of them are tested in one scan.
    """
    joined = z.where("value IS NOT NULL").join(residual, "sample_idx")
    e = F.col("e")
    sums = joined.groupBy("marker_idx", *keys).agg(
        F.count("*").alias("n"), F.sum("z").alias("sx"), F.sum(F.col("z") * F.col("z")).alias("sxx"),
        F.sum(F.col("z") * e).alias("ze"), F.sum(e).alias("se"), F.sum(e * e).alias("see"),
    )
    own = F.col("x") / F.sqrt(F.lit(float(n_samples)))
    return (
        sums.join(x, ["marker_idx", *keys])
        .withColumn("sxy", F.col("ze") + own * F.col("sxx"))
        .withColumn("sy", F.col("se") + own * F.col("sx"))
        .withColumn("syy", F.col("see") + 2 * own * F.col("ze") + own * own * F.col("sxx"))
        .select(*keys, "marker_idx", "n", t_statistic().alias("t"))
    )


def chromosome_predictor(z: DataFrame, x: DataFrame, chrom: DataFrame, n_samples: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``chrom, sample_idx, value``: what each chromosome's markers predict."""
    return (
        z.join(x, "marker_idx")
        .join(chrom, "marker_idx")
        .groupBy(*keys, "chrom", "sample_idx")
        .agg((F.sum(F.col("z") * F.col("x")) / F.sqrt(F.lit(float(n_samples)))).alias("value"))
    )


def leave_one_chromosome_out(z: DataFrame, residual: DataFrame, x: DataFrame, chrom: DataFrame, n_samples: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``chrom, marker_idx, n, t``.  Markers on no chromosome from 1 to 23 have a null t."""
    own = chromosome_predictor(z, x, chrom, n_samples, keys)
    adjusted = own.join(residual, ["sample_idx", *keys]).select(
        *keys, "chrom", "sample_idx", (F.col("e") + F.col("value")).alias("ec")
    )
    sums = (
        z.where("value IS NOT NULL").join(chrom, "marker_idx").join(adjusted, ["chrom", "sample_idx"])
        .groupBy(*keys, "chrom", "marker_idx")
        .agg(
            F.count("*").alias("n"), F.sum("z").alias("sx"), F.sum(F.col("z") * F.col("z")).alias("sxx"),
            F.sum(F.col("z") * F.col("ec")).alias("sxy"), F.sum("ec").alias("sy"), F.sum(F.col("ec") * F.col("ec")).alias("syy"),
        )
    )
    t = F.when(F.col("chrom").between(1, 23), t_statistic())
    return sums.select(*keys, "chrom", "marker_idx", "n", t.alias("t"))


def _t(n, sx, sxx, sxy, sy, syy) -> np.ndarray:
    """As :func:`t_statistic`, NaN without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (n * sxy - sx * sy) / np.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
        t = r * np.sqrt((n - 2) / (1 - r * r))
    return np.where(np.isfinite(t), t, np.nan)


def _tests(index: np.ndarray, n: np.ndarray, t: np.ndarray, first: int, chrom: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each marker and estimate; NaN is null."""
    markers, width = t.shape
    columns = [np.tile(np.arange(first, first + width, dtype=np.int32), markers), *(np.repeat(x, width) for x in (index, n.ravel()))]
    names = ["it", "marker_idx", "n"]
    if chrom is not None:
        columns, names = [*columns, np.repeat(chrom, width)], [*names, "chrom"]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(t.ravel(), from_pandas=True)], [*names, "t"])


def packed_leave_one_out(matrix: MarkerMatrix, residual: np.ndarray, x: np.ndarray, first: int = 1) -> DataFrame:
    """``it, marker_idx, n, t`` as :func:`leave_one_out`, over packed markers.  ``residual`` has a
    row a sample and ``x`` a row a marker, both a column for each estimate; those are numbered
    from ``first``."""
    matrix = matrix.whole()
    shared = matrix.spark.sparkContext.broadcast((np.where(matrix.present[:, None], residual, 0.0), x / np.sqrt(matrix.n_samples), matrix.present))

    def tests(part, z, valid, own):
        e, effects, _ = own
        index = part.column("marker_idx").to_numpy()
        x, v = effects[index], valid.astype(float)
        n, sx, sxx = (s[:, None] for s in (valid.sum(axis=1), z.sum(axis=1), (z * z).sum(axis=1)))
        ze = z @ e
        t = _t(n, sx, sxx, ze + x * sxx, v @ e + x * sx, v @ (e * e) + 2 * x * ze + x * x * sxx)
        yield _tests(index, n, t, first)

    return matrix.mapped(tests, shared, "it int, marker_idx long, n long, t double")


def packed_chromosome_predictor(matrix: MarkerMatrix, x: np.ndarray, chrom: np.ndarray, rows: DataFrame | None = None) -> dict[int, np.ndarray]:
    """What the markers of each chromosome (those in ``rows``, if given) predict: samples by estimates."""
    shared = matrix.spark.sparkContext.broadcast((x / np.sqrt(matrix.n_samples), chrom, matrix.present))

    def products(part, z, own):
        index = part.column("marker_idx").to_numpy()
        for c in np.unique(own[1][index]).tolist():
            mine = own[1][index] == c
            yield c, z[mine].T @ own[0][index[mine]]

    return matrix.summed(products, shared, x.shape[1], rows)


def packed_leave_one_chromosome_out(matrix: MarkerMatrix, residual: np.ndarray, x: np.ndarray, chrom: np.ndarray, first: int = 1) -> DataFrame:
    """``it, marker_idx, n, chrom, t`` as :func:`leave_one_chromosome_out`, over packed markers
    whose chromosomes are ``chrom``.

    Predictors of ``PREDICTOR_BYTES`` are broadcast at a time: of several estimates, or of one
    and as many chromosomes, whose markers alone are read then.  A predictor has 8 bytes a sample.
    """
    matrix, known = matrix.whole(), np.unique(chrom)
    room = max(1, PREDICTOR_BYTES // (8 * matrix.n_samples))
    step, found = max(1, room // len(known)), None
    for a in range(0, x.shape[1], step):
        for k in range(0, len(known), max(1, room)):
            own = known[k : k + room] if room < len(known) else None
            part = _leave_one_chromosome_out(matrix, residual[:, a : a + step], x[:, a : a + step], chrom, first + a, own)
            found = part if found is None else found.union(part)
    return found


def _of_chromosomes(matrix: MarkerMatrix, chrom: np.ndarray, own: np.ndarray) -> DataFrame:
    """The matrix's rows on some chromosomes, as a filter on runs of markers: one a chromosome, if
    they stand together."""
    inside = np.isin(chrom, own)
    starts, ends = (np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(int), [0]])) == d) for d in (1, -1))
    within = F.lit(False)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        within = within | F.col("marker_idx").between(a, b - 1)
    return matrix.rows.where(within)


def _leave_one_chromosome_out(matrix: MarkerMatrix, residual: np.ndarray, x: np.ndarray, chrom: np.ndarray, first: int, own: np.ndarray | None = None) -> DataFrame:
    rows = None if own is None else _of_chromosomes(matrix, chrom, own)
    e = np.where(matrix.present[:, None], residual, 0.0)
    adjusted = {c: np.where(matrix.present[:, None], e + p, 0.0) for c, p in packed_chromosome_predictor(matrix, x, chrom, rows).items()}
    shared = matrix.spark.sparkContext.broadcast((adjusted, chrom, matrix.present))

    def tests(part, z, valid, own):
        index = part.column("marker_idx").to_numpy()
        of = own[1][index]
        for c in np.unique(of).tolist():
            mine, e = of == c, own[0][c]
            zc, v = z[mine], valid[mine].astype(float)
            n, sx, sxx = (s[:, None] for s in (valid[mine].sum(axis=1), zc.sum(axis=1), (zc * zc).sum(axis=1)))
            t = _t(n, sx, sxx, zc @ e, v @ e, v @ (e * e))
            yield _tests(index[mine], n, t if 1 <= c <= 23 else np.full_like(t, np.nan), first, of[mine].astype(np.int32))

    return matrix.mapped(tests, shared, "it int, marker_idx long, n long, chrom int, t double", rows)


def lead_markers(tests: DataFrame, k: int, by: str = "chrom") -> DataFrame:
    """The ``k`` strongest markers of each group."""
    order = f"PARTITION BY {by} ORDER BY abs(t) DESC NULLS LAST, marker_idx"
    return tests.withColumn("rank", F.expr(f"row_number() OVER ({order})")).where(F.col("rank") <= k)
